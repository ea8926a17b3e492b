"""The command language: parsing, variables, conditionals and loops."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ScriptError(ValueError):
    pass


@dataclass(frozen=True)
class Command:
    name: str
    params: dict[str, str | None] = field(default_factory=dict)

    def has(self, key: str) -> bool:
        return key in self.params

    def get(self, key: str, default: str | None = None) -> str | None:
        v = self.params.get(key, default)
        return default if v is None else v

    def num(self, key: str, default: float | None = None) -> float | None:
        v = self.get(key)
        return default if v is None else float(v)

    def list(self, key: str, default: str = "") -> list[str]:
        return [x for x in (self.get(key, default) or "").split(",") if x]

    def yes(self, key: str) -> bool:
        return key in self.params and (self.params[key] or "T").lower() not in ("f", "false", "0", "no", "n")


def _split(text: str, marks: str) -> list[str]:
    """Parts between ``marks`` outside quotes."""
    out, part, quote = [], "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in marks:
            out.append(part)
            part = ""
            continue
        part += c
    return [*out, part]


def lines(text: str) -> list[str]:
    """Command lines: % starts a comment, & separates, a leading + or ... continues the line before."""
    out: list[str] = []
    for raw in text.splitlines():
        raw = _split(raw, "%")[0]
        for k, part in enumerate(_split(raw, "&")):
            s = part.strip()
            if k == 0 and out and re.match(r"\+|\.\.\.", s):
                out[-1] += " " + re.sub(r"^(\+|\.\.\.)\s*", "", s)
            elif s:
                out.append(s)
    return out


def expanded(word: str) -> list[str]:
    """``C[1:3]`` or ``[F,C][3,4]`` spelled out."""
    m = re.search(r"\[([^\[\]]+)\]", word)
    if not m:
        return [word]
    r = re.fullmatch(r"(-?\d+):(-?\d+)", m[1])
    items = [str(i) for i in range(int(r[1]), int(r[2]) + 1)] if r else m[1].split(",")
    return [y for x in items for y in expanded(word[: m.start()] + x + word[m.end() :])]


def substituted(line: str, variables: dict[str, str]) -> str:
    """``${x}`` uses, ``${x=v}`` defines, ``${x+=v}`` appends, ``${x:=n}`` computes a number, ``?{x}`` tests."""

    def one(m: re.Match) -> str:
        body = m[1]
        for op in ("+=", ":=", "="):
            if op in body:
                name, value = body.split(op, 1)
                if op == "+=":
                    variables[name] = ",".join(filter(None, (variables.get(name), value)))
                elif op == ":=":
                    if not re.fullmatch(r"[\d\s.+\-*/()]+", value):
                        raise ScriptError(f"not a number: {value}")
                    variables[name] = f"{eval(value, {'__builtins__': {}}):g}"  # noqa: S307  digits and operators only
                else:
                    variables[name] = ",".join(y for x in value.split(",") for y in expanded(x))
                return ""
        if body not in variables:
            raise ScriptError(f"undefined variable {body}")
        return variables[body]

    line = re.sub(r"\$\{([^{}]*)\}", one, line)
    return re.sub(r"\?\{([^{}]*)\}", lambda m: "1" if variables.get(m[1], "0").lower() not in ("0", "f", "false", "no", "n", "", ".") else "0", line)


def _truth(line: str, variables: dict[str, str]) -> bool:
    """IF var, IF var=value or IF 0/1."""
    _, _, test = line.partition(" ")
    test = test.strip()
    if "=" in test:
        name, value = test.split("=", 1)
        return variables.get(name.strip()) == value.strip()
    return variables.get(test, test).lower() not in ("0", "f", "false", "no", "n", "", ".", test.lower() if test not in variables and test != "1" else "\0")


def _word(line: str) -> str:
    return line.split(None, 1)[0].upper() if line.split() else ""


def unrolled(source: list[str], variables: dict[str, str]) -> list[str]:
    """Lines with IF blocks decided and LOOPs written out; unmatched blocks are refused."""
    out: list[str] = []
    i = 0
    while i < len(source):
        w = _word(source[i])
        if w in ("IF", "IFNOT", "LOOP"):
            ends, depth, j = (("FI", "ENDIF") if w != "LOOP" else ("END-LOOP",)), 0, i
            opens = ("IF", "IFNOT") if w != "LOOP" else ("LOOP",)
            while j < len(source):
                depth += _word(source[j]) in opens
                depth -= _word(source[j]) in ends
                if depth == 0:
                    break
                j += 1
            if depth:
                raise ScriptError(f"{w} without {ends[0]}")
            body = source[i + 1 : j]
            if w == "LOOP":
                args = dict(x.split("=", 1) for x in source[i].split()[1:] if "=" in x)
                for v in substituted(args.get("vals", ""), variables).split(","):
                    variables[args["index"]] = v
                    out += unrolled(body, variables)
            elif _truth(substituted(source[i], variables), variables) == (w == "IF"):
                out += unrolled(body, variables)
            i = j + 1
            continue
        if w in ("FI", "ENDIF", "END-LOOP"):
            raise ScriptError(f"{w} without a block")
        line = substituted(source[i], variables).strip()
        if m := re.fullmatch(r"([\w.-]+)=(\S*)", line):
            variables[m[1]] = m[2]
        elif line:
            out.append(line)
        i += 1
    return out


def parse(text: str, variables: dict[str, str] | None = None) -> list[Command]:
    out = []
    for line in unrolled(lines(text), variables if variables is not None else {}):
        words = [w for w in _split(line, " \t") if w]
        params: dict[str, str | None] = {}
        for w in words[1:]:
            key, eq, value = w.partition("=")
            if eq and value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
                value = value[1:-1]
            value = ",".join(y for x in value.split(",") for y in expanded(x)) if key in ("sig", "sig1", "sig2", "ref", "annot") else value
            params[key] = (params[key] + "," + value if key in params and params[key] and eq else value) if eq else None
        out.append(Command(words[0].upper() if words[0] not in ("uV", "mV") else words[0], params))
    return out
