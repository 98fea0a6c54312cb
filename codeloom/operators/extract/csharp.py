"""C# without a compiler: a scanner emits declarations, scopes and chains of names and calls; joins bind them.

``facts`` runs per file. Besides method rows it emits what the file alone tells: types by full name with
their bases, members and methods with the types they are declared with, the prefixes under which a scope looks
names up (the type, those around it, its namespaces, the file's ``using`` lines), and every expression that
holds a call as a chain: where it starts (a declared type, ``this``, ``base`` or a bare name) and the members and calls
that follow, so ``a.B().C()`` is one chain of three steps. What a name means in which scope is left to
:func:`codeloom.operators.extract.csharp_bind.resolve`.

Types are written with every name marked, arguments in order: ``List<Order>`` is ``@List`1;<@Order;>``, a type
parameter of the type is ``!0``, one of the method ``!!0``, an array ``@[]`1;<...>``.

The scanner goes from one bracket or semicolon to the next, and over each method body once, so a file costs in
proportion to its length. A local's type is that of its declaration, of a pattern, of what it creates, or of the chain
that it comes from; a loop's variable has the type of what it runs over.

Known gaps: overloads (one edge per name, the least of their results), type arguments that only a call's arguments
tell, parameters of lambdas, ``using static``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from codeloom.operators.extract.base import Fact

NAME = "C# (.NET)"

# Fixed value: classes named so give no rows and no edges.
MIGRATION = "Migration"

_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|@\"(?:[^\"]|\"\")*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|^[ \t]*#[^\n]*", re.S | re.M)
_TYPE = re.compile(r"\b(?P<kind>class|interface|struct|record(?:\s+(?:struct|class))?|enum)\s+(?P<name>\w+)\s*(?P<args><[^{}()]*?>)?(?:\s*\([^{}]*\))?\s*(?::(?P<bases>[^{]*?))?(?:\bwhere\b.*)?$", re.S)
_METHOD = re.compile(r"(?P<type>[\w.<>\[\],?\s]+?)\s+(?:[\w.<>,\s]+\.)?(?P<name>\w+)\s*(?P<args><[\w\s,]*>)?\s*\((?P<params>[^{}]*)\)\s*(?:where\b.*)?$", re.S)
_FIELD = re.compile(r"(?P<type>[\w.]+(?:\s*<[^=;{}()]*>)?(?:\[\])?\??)\s+(?P<name>\w+)\s*$", re.S)
_INDEXER = re.compile(r"(?P<type>[\w.]+(?:\s*<[^=;{}()]*>)?\??)\s+this\s*\[", re.S)
_MODIFIER = re.compile(r"^(?:\s*\[[^\]]*\])*\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|readonly|partial|new|extern|unsafe|const|required|volatile|event)\b\s*)*", re.S)
_USING = re.compile(r"^[ \t]*(?P<everywhere>global\s+)?using\s+(?:(?P<alias>\w+)\s*=\s*(?P<target>[\w.<>,\s]+?)|(?P<space>[\w.]+))\s*;", re.M)
_TOKEN = re.compile(r"[A-Za-z_@]\w*|\d[\w.]*|\?\.|=>|\?\?|::|[^\s\w]")
_NAME = re.compile(r"[A-Za-z_]\w*$")
_PART = re.compile(r"[\w.]+|[<>,?]|\[\s*,*\s*\]")
_MARK = re.compile(r"[()\[\]{};]")
_BRACE = re.compile(r"[{}]")
_WORDS = set("if for foreach while switch using lock catch fixed return throw new nameof typeof sizeof default checked unchecked when await else do try finally get set init add remove in is as out ref base this var yield goto case and or not null true false".split())
_HEADS = set("for foreach if while switch using lock catch fixed when".split())
_TASKS = {"Task", "ValueTask", "System.Threading.Tasks.Task", "System.Threading.Tasks.ValueTask"}


def clean(text: str) -> str:
    """Comments, strings, characters and directives blanked, every other character in its place."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _split(text: str) -> list[str]:
    """At commas outside of type arguments, brackets and parentheses."""
    out, depth, begin = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "<([") - (ch in ">)]")
        if ch == "," and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [x for x in [*out, text[begin:]] if x.strip()]


def _names(args: str | None) -> list[str]:
    """Names of type parameters, from ``<in T, out U>``."""
    return [x.split()[-1] for x in _split((args or "").strip()[1:-1])]


class Types:
    """Writes types as marked names; knows a file's aliases and the type parameters in scope."""

    def __init__(self, aliases: dict[str, str], params: dict[str, str] | None = None):
        self.aliases, self.params = aliases, params or {}

    def inside(self, names: list[str], mark: str) -> Types:
        return Types(self.aliases, {**self.params, **{n: f"{mark}{k}" for k, n in enumerate(names)}})

    def write(self, text: str) -> str:
        """'' for what is no type."""
        parts = _PART.findall(text)
        return self._read(parts, 0)[0] if parts else ""

    def _read(self, parts: list[str], at: int) -> tuple[str, int]:
        name, at, args = parts[at], at + 1, []
        if at < len(parts) and parts[at] == "<":
            at += 1
            while at < len(parts) and parts[at] != ">":
                if parts[at] == ",":
                    at += 1
                    continue
                one, at = self._read(parts, at)
                args.append(one)
            at += 1
        out = self._named(name, args)
        while at < len(parts) and (parts[at] == "?" or parts[at][0] == "["):
            out = f"@[]`1;<{out}>" if parts[at][0] == "[" else out
            at += 1
        return out, at

    def _named(self, name: str, args: list[str]) -> str:
        if not re.match(r"[A-Za-z_]", name) or name == "void":
            return ""
        if name in self.params and not args:
            return self.params[name]
        first, dot, rest = name.partition(".")
        if first in self.aliases:
            target = self.aliases[first]
            if not dot and not args:
                return Types({}, self.params).write(target)
            name = target + dot + rest
        return f"@{name}`{len(args)};<{','.join(args)}>" if args else f"@{name};"

    def result(self, text: str) -> str:
        """What awaiting gives: the argument of a task."""
        m = re.match(r"([\w.]+)\s*<(.*)>\s*\??$", text.strip(), re.S)
        return self.write(m[2] if m and m[1] in _TASKS else text)


def _params(text: str) -> dict[str, str]:
    out = {}
    for part in _split(text):
        words = re.sub(r"^\s*(\[[^\]]*\]\s*)*", "", part.split("=")[0]).split()
        if len(words) >= 2:
            out[words[-1]] = " ".join(w for w in words[:-1] if w not in {"this", "ref", "out", "in", "params"})
    return out


class Body:
    """One pass over a method's body: its chains, and its calls as (chain, step, name) in the order of a tree walk."""

    def __init__(self, text: str, types: Types, scope: dict[str, list[str]]):
        self.types, self.scope = types, scope
        self.tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.words = [t[0] for t in self.tokens] + [""] * 4
        self.text = text
        self.close: dict[int, int] = {}
        opened = []
        for i, w in enumerate(self.words):
            if w in ("(", "[", "{"):
                opened.append(i)
            elif w in (")", "]", "}") and opened:
                self.close[opened.pop()] = i
        self.chains: list[list[str]] = []
        self.calls: list[tuple] = []  # (begin, -end, chain, step, name)
        self._walk()

    def ordered(self) -> list[tuple[int, int, str]]:
        return [c[2:] for c in sorted(self.calls)]

    def _walk(self) -> None:
        todo = [(0, len(self.tokens))]
        while todo:
            at, end = todo.pop()
            if at >= end:
                continue
            step, inner = self._statement(at)
            todo.append((max(step, at + 1), end))
            todo += reversed(inner)

    def _is_name(self, at: int) -> bool:
        return bool(_NAME.match(self.words[at])) and self.words[at] not in _WORDS

    def _arguments(self, at: int) -> int | None:
        """After the type arguments that begin at ``at``, if they are some."""
        depth, end = 0, min(len(self.tokens), at + 200)
        for i in range(at, end):
            w = self.words[i]
            depth += (w == "<") - (w == ">")
            if not depth:
                return i + 1
            if not (w in "<>,.?[]" or _NAME.match(w)):
                return None
        return None

    def _type(self, at: int) -> tuple[str, int] | None:
        """(text, token after) of a type that begins at ``at``."""
        begin = at
        if not self._is_name(at):
            return None
        at += 1
        while self.words[at] == "." and self._is_name(at + 1):
            at += 2
        if self.words[at] == "<":
            at = self._arguments(at)
            if not at:
                return None
        while self.words[at] == "?" or self.words[at] == "[" and self.words[at + 1] in ("]", ","):
            at = at + 1 if self.words[at] == "?" else self.close.get(at, at) + 1
        return self.text[self.tokens[begin][1] : self.tokens[at - 1][2]], at

    def _statement(self, at: int) -> tuple[int, list[tuple[int, int]]]:
        """(token to go on from, ranges of arguments to scan before)."""
        word, before = self.words[at], self.words[at - 1] if at else ";"
        declares = before in (";", "{", "}", "(", "=>", "out", "is", "using", "await", "not", ":", ")") or before == ""
        if declares and word == "var" and self._is_name(at + 1):
            name, after = self.words[at + 1], self.words[at + 2]
            if after in ("=", "in"):
                found, end, inner = self._value(at + 3)
                ended = self.words[end] in (";", ",", ")", "??", "!")
                self.scope[name] = ([*found, "each"] if after == "in" else found) if found and ended else ["U"]
                return end, inner
            return at + 2, []
        if declares and self._is_name(at) and (kind := self._type(at)) and self._is_name(kind[1]):
            after = self.words[kind[1] + 1]
            if after in ("=", ";", "in") or before in ("out", "is", "not") or after == "," and before != "(":
                if after != "=" or self.words[kind[1] + 2] != "=":
                    self.scope[self.words[kind[1]]] = ["T", self.types.write(kind[0])]
                    return kind[1] + 1, []
        if word == "(" and before in _HEADS:
            return at + 1, []
        if word in ("this", "base", "new", "(") or self._is_name(at):
            if before in (".", "?."):
                return at + 1, []  # what follows has been read with what it hangs on
            found, end, inner = self._chain(at)
            return end, inner
        return at + 1, []

    def _value(self, at: int) -> tuple[list[str] | None, int, list]:
        """An expression's chain; a cast's type; what ``await`` waits for."""
        while self.words[at] == "await":
            at += 1
        if self.words[at] == "(" and (cast := self._cast(at)):
            _, end, inner = self._value(self.close[at] + 1)
            return ["T", cast], end, inner
        found, end, inner = self._chain(at)
        if self.words[end] == "as" and (kind := self._type(end + 1)):
            return ["T", self.types.write(kind[0])], kind[1], inner
        return found, end, inner

    def _cast(self, at: int) -> str | None:
        """The type in the parentheses at ``at``, if they are a cast."""
        kind = self._type(at + 1)
        if not kind or at not in self.close or kind[1] != self.close[at]:
            return None
        after = self.words[self.close[at] + 1]
        return self.types.write(kind[0]) if after in ("(", "this", "new", "base", "await") or self._is_name(self.close[at] + 1) else None

    def _chain(self, at: int) -> tuple[list[str] | None, int, list]:
        """(start and steps, token after, ranges of arguments) of the expression at ``at``."""
        begin, word, inner = self.tokens[at][1] if at < len(self.tokens) else 0, self.words[at], []
        pending: list[tuple[int, str, int]] = []  # calls: step, name, end
        if word == "(":
            opens = self.words[at + 1] in ("(", "this", "base", "new", "await") or self._is_name(at + 1)
            if at not in self.close or not opens or self._cast(at):
                return None, at + 1, []
            found, end, inner = self._value(at + 1)
            if found is None or end != self.close[at]:
                return None, max(end, at + 1), inner
            chain, at = list(found), self.close[at] + 1
        elif word == "new":
            kind = self._type(at + 1)
            at = kind[1] if kind else at + 1
            chain = ["T", self.types.write(kind[0])] if kind else ["U"]
            while self.words[at] in ("(", "{", "[") and at in self.close:
                if self.words[at] == "[":
                    chain = ["T", f"@[]`1;<{chain[1]}>"] if chain[0] == "T" else chain
                inner.append((at + 1, self.close[at]))
                at = self.close[at] + 1
        elif word in ("this", "base"):
            chain, at = ["S" if word == "this" else "B"], at + 1
        elif self._is_name(at):
            if word in self.scope and self.words[at + 1] != "(":
                chain, at = list(self.scope[word]), at + 1
            else:
                alias = word in self.types.aliases and self.words[at + 1] in (".", "?.")
                chain = ["T", self.types.write(word)] if alias else ["N"]
                at = at + 1 if alias else self._step(at, chain, inner, pending)
        else:
            return None, at + 1, []
        while True:
            if self.words[at] == "!" and self.words[at + 1] in (".", "?."):
                at += 1
            elif self.words[at] in (".", "?.") and _NAME.match(self.words[at + 1]):
                at = self._step(at + 1, chain, inner, pending)
            elif self.words[at] == "[" and at in self.close and (self.close[at] > at + 1 or self.words[at + 2] in (".", "?.", "[")):  # texts are blank
                chain.append("[]")
                inner.append((at + 1, self.close[at]))
                at = self.close[at] + 1
            else:
                break
        if pending and chain[0] != "U":
            for step, name, end in pending:
                self.calls.append((begin, -end, len(self.chains), step, name))
            self.chains.append(list(chain))
        return (None if chain[0] == "U" else chain), at, inner

    def _step(self, at: int, chain: list[str], inner: list, pending: list) -> int:
        """Add the member or call at ``at`` to a chain."""
        name, args, after = self.words[at], "", at + 1
        if self.words[after] == "<" and (end := self._arguments(after)) and self.words[end] in ("(", "."):
            args = self.types.write("X" + self.text[self.tokens[after][1] : self.tokens[end - 1][2]]).partition(";")[2]
            after = end
        if self.words[after] == "(" and after in self.close:
            end = self.close[after]
            pending.append((len(chain) - (2 if chain[0] == "T" else 1), name, self.tokens[end][2]))
            chain.append(f"{name}(){args}")
            inner.append((after + 1, end))
            return end + 1
        chain.append(f"{name}`{args.count(',') + 1}" if args and chain == ["N"] else name)
        return after


def facts(path: str, text: str) -> Iterator[Fact]:
    src = clean(text)
    usings, aliases = [], {}
    out: list[Fact] = []
    for m in _USING.finditer(src):
        if m["alias"]:
            aliases[m["alias"]] = m["target"]
        elif m["everywhere"]:
            out.append(("cs_everywhere", None, f"{m['space']}.", None, None, None))
        else:
            usings.append(f"{m['space']}.")
    space, start = "", 0
    if m := re.search(r"\bnamespace\s+([\w.]+)\s*;", src):
        space = m[1]
    stack: list[tuple] = []  # (what, name, kind, full name, types)
    paren = n_chains = 0

    def owner():
        return next((f for f in reversed(stack) if f[0] == "type"), None)

    def member_level():
        return bool(stack) and stack[-1][0] == "type"

    def current_class():
        return next((f[1] for f in reversed(stack) if f[0] == "type" and f[2] in ("class", "record class")), None)

    def declare(m: re.Match, head: str, plain: str):
        own, params = owner(), _names(m["args"])
        kind = "record class" if m["kind"] == "record" else m["kind"]
        full = (f"{own[3]}." if own else f"{space}." if space else "") + m["name"] + (f"`{len(params)}" if params else "")
        types = (own[4] if own else Types(aliases)).inside(params, "!")
        bases = "\t".join(x for x in (types.write(re.sub(r"\(.*", "", b, flags=re.S)) for b in _split(m["bases"] or "")) if x)
        out.append(("cs_type", full, space, ("abstract " if re.search(r"\babstract\b", head) else "") + kind, m["name"], bases))
        spaces = [".".join(space.split(".")[:k]) + "." for k in range(space.count(".") + 1, 0, -1)] if space else []
        prefixes = [(f"{full}.", "type")] + [(f"{f[3]}.", "type") for f in reversed(stack) if f[0] == "type"] + [(s, "space") for s in [*spaces, ""]]
        out.extend(("cs_scope", full, p, str(k), kind, None) for k, (p, kind) in enumerate(prefixes))
        out.extend(("cs_scope", full, p, str(len(prefixes)), "space", None) for p in dict.fromkeys(usings))
        stack.append(("type", m["name"], kind, full, types))
        if m["kind"].startswith("record") and (p := re.search(r"\(([^{}]*)\)", plain)):
            out.extend(("cs_member", full, k, None, None, types.write(v)) for k, v in _params(p[1]).items())

    def method(m: re.Match, begin: int, end: int, body: tuple[int, int] | None):
        nonlocal n_chains
        own = owner()
        types = own[4].inside(_names(m["args"]), "!!")
        returned = types.result(_MODIFIER.sub("", m["type"]) or m["type"])
        params = _params(m["params"])
        out.append(("cs_method", own[3], f"{m['name']}()", own[2], None, returned))
        if m["params"].lstrip().startswith("this ") and params:
            out.append(("cs_extension", own[3], f"{m['name']}()", None, None, f"{types.write(next(iter(params.values())))}\t{returned}"))
        if MIGRATION not in own[1]:
            out.append(("method", own[1], m["name"], None, None, text[begin:end].strip()))
        cls = current_class()
        if body and cls and MIGRATION not in cls:
            found = Body(src[body[0] : body[1]], types, {name: ["T", types.write(kind)] for name, kind in params.items()})
            out.extend(("cs_chain", own[3], str(n_chains + k), None, None, "\t".join(chain)) for k, chain in enumerate(found.chains))
            out.extend(("cs_call", cls, m["name"], str(n_chains + chain), str(step), name) for chain, step, name in found.ordered())
            n_chains += len(found.chains)

    def member(m: re.Match, name: str):
        out.append(("cs_member", owner()[3], name, None, None, owner()[4].write(m["type"])))

    at = 0
    while mark := _MARK.search(src, at):
        i, ch = mark.start(), mark[0]
        at = i + 1
        if ch in "([":
            paren += 1
        elif ch in ")]":
            paren = max(0, paren - 1)
        elif ch == "{" and not paren:
            head = src[start:i]
            begin = start + len(head) - len(head.lstrip())
            plain = _MODIFIER.sub("", head)
            if m := re.search(r"\bnamespace\s+([\w.]+)\s*$", head):
                stack.append(("namespace", m[1], "", "", None))
                space = m[1] if not space else f"{space}.{m[1]}"
            elif (not stack or stack[-1][0] in ("namespace", "type")) and (m := _TYPE.search(plain)):
                declare(m, head, plain)
            elif member_level() and "=" not in plain.split("(")[0] and (m := _METHOD.search(plain)) and m["name"] not in _WORDS:
                end = _closing(src, i)
                method(m, begin, end, (i + 1, end - 1))
                at = start = end
                continue
            elif member_level():
                if m := _INDEXER.search(plain):
                    member(m, "[]")
                elif m := _FIELD.search(plain.split("=")[0]):
                    member(m, m["name"])
                at = start = _closing(src, i)  # or constructors, initialisers, operators
                continue
            else:
                stack.append(("block", "", "", "", None))
            start = i + 1
        elif ch == "}" and not paren:
            if stack:
                gone = stack.pop()
                if gone[0] == "namespace":
                    space = space.removesuffix(gone[1]).removesuffix(".")
            start = i + 1
        elif ch == ";" and not paren:
            head = src[start:i]
            if member_level():
                begin = start + len(head) - len(head.lstrip())
                left, arrow, _ = head.partition("=>")
                plain = _MODIFIER.sub("", left)
                if (m := _METHOD.search(plain)) and "=" not in plain.split("(")[0] and m["name"] not in _WORDS:
                    method(m, begin, i + 1, (start + len(left) + 2, i) if arrow else None)
                elif m := _INDEXER.search(plain):
                    member(m, "[]")
                elif m := _FIELD.search(plain.split("=")[0]):
                    member(m, m["name"])
            if (not stack or member_level() or stack[-1][0] == "namespace") and (m := _TYPE.search(_MODIFIER.sub("", head))) and m["kind"].startswith("record"):
                declare(m, head, _MODIFIER.sub("", head))  # a record without a body
                stack.pop()
            start = i + 1
    yield from out


def _closing(src: str, at: int) -> int:
    """After the brace that closes the one at ``at``."""
    depth = 0
    for m in _BRACE.finditer(src, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(src)
