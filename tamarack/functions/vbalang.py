"""VBA source text: tokens, conditional compilation, statements, expressions and control-flow graphs.

Pure functions on one module's text; nothing is executed. Trees are flat rows with parent numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_TOKENS, MAX_NESTING = 4_000_000, 512

_SPACE = "[^\\S\\r\\n]|　"
#: Rem comments are cut off in lex(): they are words at a statement's start.
_LEX = re.compile(
    rf"""(?P<continuation>(?:{_SPACE})_(?:{_SPACE})*(?:\r\n|\r|\n))|(?P<space>(?:{_SPACE})+)|(?P<newline>\r\n|\r|\n)
|(?P<comment>'[^\r\n]*)
|(?P<string>"(?:[^"\r\n]|"")*"?)|(?P<date>\#(?=[^\#\r\n]*[0-9A-Za-z][^\#\r\n]*\#)[0-9A-Za-z][^\#\r\n]*\#)
|(?P<number>&[Hh][0-9A-Fa-f]+[%&^]?|&[Oo]?[0-7]+[%&^]?|(?:\d+\.?\d*|\.\d+)(?:[EeDd][+-]?\d+)?(?:[%&@!\#]|\^(?![ \t]*[\w(.&]))?)
|(?P<identifier>\[[^\]\r\n]*\]|[^\W\d]\w*[%&@!\#$]?|[^\W\d]\w*\^(?=[,)\s]|$))|(?P<operator><>|<=|>=|:=|[^\s])""",
    re.X | re.M,
)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    column: int


def lex(text: str, most: int = MAX_TOKENS) -> list[Token]:
    """Tokens with byte offsets and lines and columns from 1; comments and joined line ends leave none."""
    out, line, line_at, at_byte, at_char = [], 1, 0, 0, 0
    skip = 0
    for m in _LEX.finditer(text):
        kind, raw = m.lastgroup, m.group()
        if m.start() < skip:
            continue
        if kind == "identifier" and raw.lower() == "rem" and (not out or out[-1].kind == "newline" or out[-1].text == ":"):
            skip = m.end() + len(re.match(r"[^\r\n]*", text[m.end() :])[0])
            continue
        at_byte += len(text[at_char : m.start()].encode())
        at_char = m.start()
        if kind == "identifier" and raw[-1:] in "&!#" and text[m.end() : m.end() + 1].strip(" \t") and (text[m.end()].isalnum() or text[m.end()] in '_"('):
            # An operator that touches both sides isn't a type suffix.
            raw = raw[:-1]
        if kind in ("string", "date", "number", "identifier", "operator", "newline"):
            if len(out) >= most:
                raise ValueError("too many tokens")
            out.append(Token(kind, raw, at_byte, at_byte + len(raw.encode()), line, m.start() - line_at + 1))
            if len(raw) < len(m.group()):
                tail = m.group()[len(raw) :]
                out.append(Token("operator", tail, at_byte + len(raw.encode()), at_byte + len(m.group().encode()), line, m.start() - line_at + 1 + len(raw)))
        ends = raw.count("\r\n") + raw.replace("\r\n", "").count("\n") + raw.replace("\r\n", "").count("\r")
        if ends:
            line, line_at = line + ends, m.end()
    out.append(Token("eof", "", len(text.encode()), len(text.encode()), line, len(text) - line_at + 1))
    return out


# Expressions

#: Binding of binary operators, loosest first.
LEVELS = (("imp",), ("eqv",), ("xor",), ("or",), ("and",), ("=", "<>", "<", ">", "<=", ">=", "is", "like"), ("&",), ("+", "-"), ("mod",), ("\\",), ("*", "/"), ("^",))
_POWER = {op: k for k, ops in enumerate(LEVELS, 1) for op in ops}
_NOT, _NEG = 5.5, 11.5


def parse_expression(tokens: list[Token]) -> dict | None:
    """Tree of an expression: {kind, text, children}; None if the tokens are none."""
    pos = 0

    def peek():
        return tokens[pos].text.lower() if pos < len(tokens) else ""

    def operand(depth):
        nonlocal pos
        if pos >= len(tokens) or depth > MAX_NESTING:
            raise ValueError
        t = tokens[pos]
        low = t.text.lower()
        pos += 1
        if low == "not":
            return {"kind": "unary", "text": "Not", "children": [binary(_NOT, depth + 1)]}
        if low in "+-" and t.kind == "operator":
            return {"kind": "unary", "text": low, "children": [binary(_NEG, depth + 1)]}
        if low in ("new", "addressof", "typeof") and t.kind == "identifier":
            return {"kind": low, "text": t.text, "children": [operand(depth + 1)]}
        if low == "(":
            inner = binary(0, depth + 1)
            need(")")
            return postfix({"kind": "group", "text": "", "children": [inner]}, depth)
        if t.kind in ("string", "number", "date"):
            return {"kind": t.kind, "text": t.text, "children": []}
        if t.kind == "identifier":
            kind = "literal" if low in ("true", "false", "null", "empty", "nothing") else "name"
            return postfix({"kind": kind, "text": t.text.strip("[]"), "children": []}, depth)
        if low in (".", "!"):
            pos -= 1
            return postfix({"kind": "with_target", "text": "", "children": []}, depth)
        raise ValueError

    def need(text):
        nonlocal pos
        if peek() != text:
            raise ValueError
        pos += 1

    def postfix(node, depth):
        nonlocal pos
        while True:
            if peek() in (".", "!") and pos + 1 < len(tokens) and tokens[pos + 1].kind == "identifier":
                kind = "member" if peek() == "." else "dictionary"
                node = {"kind": kind, "text": tokens[pos + 1].text.strip("[]"), "children": [node]}
                pos += 2
            elif peek() == "(":
                pos += 1
                args = []
                while peek() != ")":
                    if peek() == ",":
                        args.append({"kind": "missing", "text": "", "children": []})
                    elif pos + 1 < len(tokens) and tokens[pos + 1].text == ":=":
                        name = tokens[pos].text
                        pos += 2
                        args.append({"kind": "named", "text": name, "children": [binary(0, depth + 1)]})
                    else:
                        args.append(binary(0, depth + 1))
                    if peek() == ",":
                        pos += 1
                    elif peek() != ")":
                        raise ValueError
                pos += 1
                node = {"kind": "index", "text": "", "children": [node, *args]}
            else:
                return node

    def binary(least, depth):
        nonlocal pos
        left = operand(depth)
        while (power := _POWER.get(peek())) and power > least:
            op = tokens[pos].text
            pos += 1
            left = {"kind": "binary", "text": op, "children": [left, binary(power, depth + 1)]}
        return left

    try:
        out = binary(0, 0)
    except (ValueError, RecursionError):
        return None
    return out if pos == len(tokens) else None


def walk(tree: dict | None, parent: int = -1, ordinal: int = 0, out: list | None = None) -> list[tuple]:
    """(node, parent, ordinal, kind, text) of a tree's nodes, parents first."""
    out = [] if out is None else out
    if tree is not None:
        me = len(out)
        out.append((me, parent, ordinal, tree["kind"], tree["text"]))
        for k, c in enumerate(tree["children"]):
            walk(c, me, k, out)
    return out


# Conditional compilation

_CONST_OPS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "^": lambda a, b: a**b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def _number(text: str):
    low = text.lower()
    if low.startswith("&h"):
        return int(re.sub(r"[%&^]$", "", low[2:]), 16)
    if low.startswith("&"):
        return int(re.sub(r"[%&^]$", "", low.lstrip("&o")) or "0", 8)
    body = re.sub(r"[%&^@!#]$", "", low).replace("d", "e")
    return float(body) if "." in body or "e" in body else int(body)


def constant(tree: dict | None, known: dict):
    """Value of a constant expression: bool, number or str; None if it can't be known."""
    if tree is None:
        return None
    kind, text, kids = tree["kind"], tree["text"], tree["children"]
    if kind == "number":
        return _number(text)
    if kind == "string":
        return text[1:].removesuffix('"').replace('""', '"')
    if kind == "literal":
        return {"true": True, "false": False, "empty": 0}.get(text.lower())
    if kind == "name":
        return known.get(text.lower())
    if kind == "group":
        return constant(kids[0], known)
    if kind == "unary":
        v = constant(kids[0], known)
        if v is None or isinstance(v, str):
            return None
        return (not v if isinstance(v, bool) else ~int(v)) if text == "Not" else -v if text == "-" else +v
    if kind == "binary":
        a, b, op = constant(kids[0], known), constant(kids[1], known), text.lower()
        # False And x, True Or x are known whatever x is.
        if op == "and" and (a is False or b is False):
            return False
        if op == "or" and (a is True or b is True):
            return True
        if a is None or b is None:
            return None
        try:
            if op == "&":
                return str(a) + str(b)
            if isinstance(a, str) != isinstance(b, str):
                return None
            num = lambda v: -int(v) if isinstance(v, bool) else v
            if op in ("and", "or", "xor", "eqv", "imp"):
                if isinstance(a, bool) and isinstance(b, bool):
                    return {"and": a and b, "or": a or b, "xor": a != b, "eqv": a == b, "imp": not a or b}[op]
                x, y = int(num(a)), int(num(b))
                return {"and": x & y, "or": x | y, "xor": x ^ y, "eqv": ~(x ^ y), "imp": ~x | y}[op]
            if op == "\\":
                q = round(num(a)) / round(num(b))
                return int(q)
            if op == "mod":
                return abs(round(num(a))) % abs(round(num(b)))
            if op in _CONST_OPS:
                return _CONST_OPS[op](num(a), num(b)) if not isinstance(a, str) else _CONST_OPS[op](a, b)
        except (ZeroDivisionError, OverflowError, TypeError, ValueError):
            return None
    return None


_DIRECTIVE = re.compile(r"^\s*#\s*(if|elseif|else|end\s*if|const)\b(.*)$", re.I)


def preprocess(text: str, known: dict | None = None) -> tuple[str, list[tuple[int, str]]]:
    """Text with directives and excluded lines masked by spaces, and (line, problem).

    A condition that can't be known keeps all alternatives of its block. Offsets stay as they are.
    """
    known = {k.lower(): v for k, v in (known or {}).items()}
    out, problems, frames = [], [], []
    for no, line in enumerate(re.split(r"(?<=\n)|(?<=\r)(?!\n)", text), 1):
        body = line.rstrip("\r\n")
        m = _DIRECTIVE.match(body)
        active = all(f["on"] for f in frames)
        if not m:
            out.append(line if active else re.sub(r"[^\r\n]", " ", line))
            continue
        out.append(re.sub(r"[^\r\n]", " ", line))
        word, rest = re.sub(r"\s", "", m[1].lower()), m[2]
        if word in ("if", "elseif"):
            cond = constant(parse_expression([t for t in lex(re.sub(r"\bthen\s*('.*)?$", "", rest, flags=re.I)) if t.kind not in ("newline", "eof")]), known)
            value = None if cond is None or isinstance(cond, str) else bool(cond)
        if word == "if":
            frames.append({"on": value is not False, "done": value is True, "unknown": value is None})
            if value is None and active:
                problems.append((no, "condition can't be known; all alternatives are kept"))
        elif word == "const":
            name, eq, expr = rest.partition("=")
            if eq and active:
                known[name.strip().lower()] = constant(parse_expression([t for t in lex(expr) if t.kind not in ("newline", "eof")]), known)
            elif not eq:
                problems.append((no, "constant without a value"))
        elif not frames:
            problems.append((no, f"#{m[1]} without #If"))
        elif word == "elseif":
            f = frames[-1]
            f["on"] = f["unknown"] or (not f["done"] and value is not False)
            f["done"] |= value is True
            f["unknown"] |= value is None and not f["done"]
        elif word == "else":
            frames[-1]["on"] = frames[-1]["unknown"] or not frames[-1]["done"]
            frames[-1]["done"] = True
        else:
            frames.pop()
    if frames:
        problems.append((text.count("\n") + 1, "#If without #End If"))
    return "".join(out), problems


# Statements


@dataclass
class Statement:
    kind: str
    text: str
    tokens: list[Token]
    children: list[Statement] = field(default_factory=list)

    @property
    def span(self):
        return (self.tokens[0].start, self.tokens[-1].end, self.tokens[0].line) if self.tokens else (0, 0, 0)


def logical_lines(tokens: list[Token]) -> list[list[Token]]:
    """Statements' tokens: cut at line ends, and at colons that don't stand after a label or in a named argument."""
    out, cur, depth = [], [], 0
    for t in tokens:
        if t.kind in ("newline", "eof") or t.text == ":" and depth == 0:
            if t.text == ":" and len(cur) == 1 and cur[0].kind == "identifier" and (not out or out[-1][-1].line != cur[0].line):
                cur.append(t)
            if cur:
                out.append(cur)
            cur, depth = [], 0
            continue
        depth += (t.text == "(") - (t.text == ")")
        cur.append(t)
    return out


def render(tokens: list[Token]) -> str:
    """Tokens as text: one space where the source has any between them."""
    return "".join((" " if k and t.start > tokens[k - 1].end else "") + t.text for k, t in enumerate(tokens))


_MODIFIERS = ("public", "private", "friend", "static", "default", "global")
_ENDS = {"if": ("end if", "endif"), "select": ("end select",), "for": ("next",), "do": ("loop",), "while": ("wend",), "with": ("end with",)}


def header(words: list[str]) -> tuple[str, int] | None:
    """Kind of a procedure header and where its name stands."""
    k = 0
    while k < len(words) and words[k] in _MODIFIERS:
        k += 1
    if k < len(words) and words[k] in ("sub", "function"):
        return words[k], k + 1
    if words[k : k + 1] == ["property"] and words[k + 1 : k + 2] and words[k + 1] in ("get", "let", "set"):
        return "property_" + words[k + 1], k + 2
    return None


def simple_kind(tokens: list[Token]) -> str:
    words = [t.text.lower() for t in tokens]
    two = " ".join(words[:2])
    if len(words) == 2 and words[1] == ":":
        return "label"
    if two == "on error":
        return "on_error"
    if words[0] == "on" and ("goto" in words or "gosub" in words):
        return "on_goto" if "goto" in words else "on_gosub"
    if words[0] in ("goto", "gosub") and len(words) == 2:
        return words[0]
    fixed = {"return": "gosub_return", "stop": "stop", "end": "end_statement"}
    if len(words) == 1 and words[0] in fixed:
        return fixed[words[0]]
    if words[0] in ("resume", "raiseevent", "redim", "erase", "exit", "call", "attribute", "option", "implements"):
        return {"raiseevent": "raise_event"}.get(words[0], words[0])
    k = 0
    while k < len(words) and words[k] in _MODIFIERS:
        k += 1
    if k < len(words) and (words[k] in ("dim", "const", "type", "enum", "event", "declare", "withevents") or k):
        return "declaration"
    depth = 0
    for j, w in enumerate(words):
        depth += (w == "(") - (w == ")")
        if w == "=" and depth == 0 and j and (tokens[0].kind == "identifier" or words[0] == "."):
            return "object_assignment" if words[0] == "set" else "assignment"
    return "call_or_expression" if tokens[0].kind == "identifier" or words[0] in (".", "!") else "unknown"


def parse(text: str) -> tuple[list[dict], list[Statement], list[tuple[int, str]]]:
    """(procedures {name, kind, params, line, end_line, body}, other statements, problems) of a module."""
    lines = logical_lines(lex(text))
    procs: list[dict] = []
    loose: list[Statement] = []
    problems: list[tuple[int, str]] = []
    pos = 0

    def block(ends: tuple[str, ...], depth: int, also: tuple[str, ...] = ()) -> list[Statement]:
        nonlocal pos
        out = []
        while pos < len(lines):
            words = [t.text.lower() for t in lines[pos]]
            two = " ".join(words[:2])
            if any(e == two or e == words[0] for e in ends) or words[0] in also or two in also:
                return out
            if two in ("end sub", "end function", "end property") or (header(words) and depth):
                return out
            out.append(statement(depth))
        return out

    def close(ends: tuple[str, ...], line: int):
        nonlocal pos
        if pos < len(lines):
            words = [t.text.lower() for t in lines[pos]]
            if " ".join(words[:2]) in ends or words[0] in ends:
                pos += 1
                return
        problems.append((line, f"no {ends[0]}"))

    def statement(depth: int) -> Statement:
        nonlocal pos
        toks = lines[pos]
        words = [t.text.lower() for t in toks]
        if depth > MAX_NESTING:
            raise ValueError("nesting is too deep")
        if words[0] == "if" and "then" in words:
            at = words.index("then")
            pos += 1
            cond = toks[1:at]
            if at + 1 < len(toks):
                return single_line_if(toks, words, at)
            out = Statement("if", render(cond), toks)
            branch = Statement("then_branch", render(cond), cond, block(_ENDS["if"], depth + 1, ("elseif", "else")))
            out.children.append(branch)
            while pos < len(lines) and lines[pos][0].text.lower() in ("elseif", "else"):
                head = lines[pos]
                low = [t.text.lower() for t in head]
                pos += 1
                if low[0] == "elseif":
                    c = head[1 : low.index("then")] if "then" in low else head[1:]
                    out.children.append(Statement("elseif_branch", render(c), c or head, block(_ENDS["if"], depth + 1, ("elseif", "else"))))
                else:
                    out.children.append(Statement("else_branch", "Else", head, block(_ENDS["if"], depth + 1, ("elseif", "else"))))
            close(_ENDS["if"], toks[0].line)
            return out
        if " ".join(words[:2]) == "select case":
            pos += 1
            out = Statement("select_case", render(toks[2:]), toks)
            block(_ENDS["select"], depth + 1, ("case",))
            while pos < len(lines) and lines[pos][0].text.lower() == "case":
                head = lines[pos]
                pos += 1
                out.children.append(Statement("case", render(head[1:]), head, block(_ENDS["select"], depth + 1, ("case",))))
            close(_ENDS["select"], toks[0].line)
            return out
        if words[0] in ("for", "do", "while", "with"):
            pos += 1
            out = Statement({"for": "for_each" if words[1:2] == ["each"] else "for"}.get(words[0], words[0]), render(toks[1:]), toks)
            out.children = block(_ENDS[words[0]], depth + 1)
            if words[0] == "do" and pos < len(lines) and lines[pos][0].text.lower() == "loop" and len(lines[pos]) > 1:
                out.kind, out.text = "do_post", render(lines[pos][1:])
            close(_ENDS[words[0]], toks[0].line)
            return out
        pos += 1
        return Statement(simple_kind(toks), render(toks), toks)

    def single_line_if(toks, words, at):
        depth, other = 0, None
        for k in range(at + 1, len(words)):
            depth += words[k] == "if"
            if words[k] == "else":
                if depth == 0:
                    other = k
                    break
                depth -= 1
        out = Statement("single_line_if", render(toks[1:at]), toks)
        then = toks[at + 1 : other]
        out.children.append(Statement("then_branch", render(toks[1:at]), toks[1:at], [Statement(simple_kind(then), render(then), then)] if then else []))
        if other is not None and toks[other + 1 :]:
            rest = toks[other + 1 :]
            out.children.append(Statement("else_branch", "Else", rest, [Statement(simple_kind(rest), render(rest), rest)]))
        return out

    while pos < len(lines):
        toks = lines[pos]
        found = header([t.text.lower() for t in toks])
        if found and found[1] < len(toks):
            kind, at = found
            pos += 1
            body = block((), 1)
            end = lines[pos][0].line if pos < len(lines) else toks[-1].line
            if pos < len(lines) and " ".join(t.text.lower() for t in lines[pos][:2]) in ("end sub", "end function", "end property"):
                pos += 1
            else:
                problems.append((toks[0].line, "procedure without an end"))
            procs.append({"name": toks[at].text, "kind": kind, "params": render(toks[at + 1 :]), "line": toks[0].line, "end_line": end, "body": body})
        else:
            loose.append(statement(0))
    return procs, loose, problems


# Control flow


class Graph:
    """Nodes (number, kind, label, line) and edges (from, to, condition) of one procedure."""

    def __init__(self):
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.complete = True
        self.labels: dict[str, int] = {}
        self.jumps: list[tuple[int, str]] = []
        self.loops: list[tuple[str, list[int]]] = []

    def node(self, kind, label, line):
        self.nodes.append((len(self.nodes), kind, label, line))
        return len(self.nodes) - 1

    def join(self, froms, to, cond=None):
        for f in froms:
            at, c = f if isinstance(f, tuple) else (f, cond)
            self.edges.append((at, to, c))

    def build(self, body: list[Statement]):
        entry = self.node("entry", "entry", 0)
        out = self.run(body, [entry])
        exit_ = self.node("exit", "exit", 0)
        self.join(out, exit_)
        for at, target in self.jumps:
            if target == "":
                self.edges.append((at, exit_, None))
            elif target in self.labels:
                self.edges.append((at, self.labels[target], None))
            else:
                self.complete = False
        self.entry, self.exit = entry, exit_
        return self

    def run(self, body: list[Statement], incoming: list) -> list:
        for s in body:
            incoming = self.one(s, incoming)
        return incoming

    def one(self, s: Statement, incoming: list) -> list:
        line = s.span[2]
        if s.kind in ("if", "single_line_if"):
            out, test = [], None
            cond = ""
            for b in s.children:
                if b.kind != "else_branch":
                    nxt = self.node("decision", b.text, b.span[2])
                    self.join(incoming if test is None else [(test, f"({cond}) = False")], nxt)
                    test, cond = nxt, b.text
                    gate = self.node("branch", b.text, b.span[2])
                    self.edges.append((test, gate, f"({cond}) = True"))
                else:
                    gate = self.node("branch", "Else", b.span[2])
                    self.edges.append((test, gate, f"({cond}) = False"))
                out += self.run(b.children, [gate])
            if s.children[-1].kind != "else_branch":
                bypass = self.node("implicit_else", "all conditions false", line)
                self.edges.append((test, bypass, f"({cond}) = False"))
                out.append(bypass)
            return out
        if s.kind == "select_case":
            sel = self.node("select_expression", s.text, line)
            self.join(incoming, sel)
            out, prev, missed = [], sel, None
            for c in s.children:
                if c.text.lower() == "else":
                    gate = self.node("case", "Case Else", c.span[2])
                    self.edges.append((prev, gate, missed))
                    out += self.run(c.children, [gate])
                    prev = None
                    break
                test = self.node("case_test", c.text, c.span[2])
                self.edges.append((prev, test, missed))
                gate = self.node("case", c.text, c.span[2])
                pred = case_predicate(s.text, c.text)
                self.edges.append((test, gate, pred))
                out += self.run(c.children, [gate])
                prev, missed = test, f"NOT ({pred})"
            if prev is not None:
                none = self.node("no_case_match", "no case matches", line)
                self.edges.append((prev, none, missed))
                out.append(none)
            return out
        if s.kind in ("for", "for_each", "do", "do_post", "while"):
            exits: list[int] = []
            self.loops.append(({"for_each": "for", "do_post": "do"}.get(s.kind, s.kind), exits))
            cond = loop_condition(s)
            if s.kind == "do_post":
                start = self.node("loop_body", s.text, line)
                self.join(incoming, start)
                test = self.node("loop_test", s.text, line)
                self.join(self.run(s.children, [start]), test)
                again, leave = cond
                self.edges.append((test, start, again))
            else:
                test = self.node("loop_test", s.text, line)
                self.join(incoming, test)
                again, leave = cond
                start = self.node("loop_body", s.text, line)
                self.edges.append((test, start, again))
                self.join(self.run(s.children, [start]), test)
            self.loops.pop()
            done = self.node("loop_exit", s.text, line)
            if leave != "False":
                self.edges.append((test, done, leave))
            self.join(exits, done)
            return [done]
        if s.kind == "with":
            at = self.node("with", s.text, line)
            self.join(incoming, at)
            return self.run(s.children, [at])
        at = self.node(s.kind, s.text, line)
        self.join(incoming, at)
        words = s.text.lower().split()
        if s.kind == "label":
            self.labels[words[0].rstrip(":")] = at
        elif s.kind == "goto":
            self.jumps.append((at, words[-1]))
            return []
        elif s.kind == "gosub":
            # The return comes back here; which path it takes inside is left to the target's graph.
            self.jumps.append((at, words[-1]))
            back = self.node("gosub_resume", s.text, line)
            self.edges.append((at, back, "GoSub returns"))
            return [back]
        elif s.kind == "exit":
            if len(words) > 1 and words[1] in ("for", "do"):
                found = next((e for k, e in reversed(self.loops) if k == words[1]), None)
                if found is None:
                    self.complete = False
                else:
                    found.append(at)
            else:
                self.jumps.append((at, ""))
            return []
        elif s.kind in ("end_statement", "stop"):
            if s.kind == "end_statement":
                self.jumps.append((at, ""))
                return []
        elif s.kind in ("on_goto", "on_gosub"):
            word = "goto" if s.kind == "on_goto" else "gosub"
            for t in " ".join(words[words.index(word) + 1 :]).split(","):
                self.jumps.append((at, t.strip()))
        elif s.kind == "gosub_return":
            return []
        elif s.kind in ("on_error", "unknown"):
            self.complete &= s.kind != "unknown"
        return [at]


def case_predicate(value: str, case: str) -> str:
    """Text of the test that a Case clause makes."""
    tests = []
    for part in re.split(r",(?![^(]*\))", case):
        part = part.strip()
        if m := re.match(r"(?i)^is\s*(<>|<=|>=|=|<|>)\s*(.+)$", part):
            tests.append(f"({value}) {m[1]} ({m[2]})")
        elif m := re.match(r"(?i)^(.+?)\s+to\s+(.+)$", part):
            tests.append(f"({value}) >= ({m[1]}) And ({value}) <= ({m[2]})")
        else:
            tests.append(f"({value}) = ({part})")
    return " Or ".join(tests)


def loop_condition(s: Statement) -> tuple[str | None, str | None]:
    """(condition to go on, condition to leave) of a loop's test."""
    if s.kind == "for":
        if m := re.match(r"(?i)^(\S+)\s*=\s*(.+?)\s+to\s+(.+?)(?:\s+step\s+(.+))?$", s.text):
            step = m[4] or "1"
            go = f"(({step}) >= 0 And ({m[2]}) <= ({m[3]})) Or (({step}) < 0 And ({m[2]}) >= ({m[3]}))"
            return go, f"NOT ({go})"
        return "next value", "no next value"
    if s.kind == "for_each":
        return "next element", "no next element"
    m = re.match(r"(?i)^(while|until)\s+(.+)$", s.text) if s.kind in ("do", "do_post") else None
    if s.kind == "while":
        return f"({s.text}) = True", f"({s.text}) = False"
    if m is None:
        return None, "False"
    yes, no = ("True", "False") if m[1].lower() == "while" else ("False", "True")
    return f"({m[2]}) = {yes}", f"({m[2]}) = {no}"
