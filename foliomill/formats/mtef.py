"""MathType equations (MTEF 5) to LaTeX, after the published description of the format.

Records are read into a tree: lines, characters, templates with their slots, piles, matrices. Templates without a rule make
the whole formula void ('').
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .omml import SIGNS, greek

# Record types.
LINE, CHAR, TMPL, PILE, MATRIX, EMBELL, RULER, FONT_STYLE, SIZE, FULL, SUB, SUB2, SYM, SUBSYM, COLOR, COLOR_DEF, FONT_DEF, EQN_PREFS, ENCODING = range(1, 20)
# Option bits.
NUDGE, CHAR_8, CHAR_16, CHAR_EMBELL, LINE_NULL, LINE_SPACE, LP_RULER, NO_MTCODE = 0x08, 0x04, 0x10, 0x01, 0x01, 0x04, 0x02, 0x20
# Template selectors.
ANGLE, PAREN, BRACE, BRACK, BAR, DBAR, FLOOR, CEILING, _OBRACK, INTERVAL, ROOT, FRACT, UBAR, OBAR, ARROW, INTEG, SUM, PROD, COPROD, UNION, INTER, _INTOP, _SUMOP, LIM, HBRACE, _HBRACK, _LDIV, T_SUB, T_SUP, T_SUBSUP, _DIRAC, VEC, TILDE, HAT, ARC, _JSTATUS, _STRIKE, BOX = range(38)
FENCES = {ANGLE: (r"\left\langle ", r"\right\rangle "), PAREN: (r"\left(", r"\right)"), BRACE: (r"\left\{", r"\right\}"), BRACK: (r"\left[", r"\right]"), BAR: (r"\left|", r"\right|"), DBAR: (r"\left\|", r"\right\|"), FLOOR: (r"\left\lfloor ", r"\right\rfloor "), CEILING: (r"\left\lceil ", r"\right\rceil ")}
BIG = {SUM: r"\sum", PROD: r"\prod", COPROD: r"\coprod", UNION: r"\bigcup", INTER: r"\bigcap"}
WRAP = {VEC: r"\overrightarrow", HAT: r"\widehat", TILDE: r"\widetilde", ARC: r"\overset{\frown}", UBAR: r"\underline", OBAR: r"\overline", BOX: r"\boxed"}
EMBELLISH = {2: r"\dot", 3: r"\ddot", 4: r"\dddot", 8: r"\tilde", 9: r"\hat", 11: r"\vec", 17: r"\bar"}
PRIMES = {5: "'", 6: "''", 18: "'''"}
ESCAPED = {c: "\\" + c for c in "#$%&_{}"} | {"\\": r"\backslash ", "−": "-", "′": "'", "⋅": r"\cdot ", "…": r"\ldots ", "⋯": r"\cdots ", " ": " ", " ": r"\,", " ": r"\;", " ": r"\:", "∗": "*", "⊥": r"\perp ", "∠": r"\angle ", "∅": r"\emptyset ", "∃": r"\exists ", "≡": r"\equiv ", "∼": r"\sim ", "≅": r"\cong ", "∝": r"\propto ", "°": r"^{\circ}", "∥": r"\parallel ", "△": r"\triangle ", "∴": r"\therefore ", "∵": r"\because "}


class Void(Exception):
    """The formula holds something without a rule."""


@dataclass
class Node:
    kind: int
    value: tuple = ()
    items: list = field(default_factory=list)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u8(self) -> int:
        if self.at >= len(self.data):
            raise EOFError
        self.at += 1
        return self.data[self.at - 1]

    def u16(self) -> int:
        return self.u8() | self.u8() << 8

    def string(self) -> bytes:
        end = self.data.find(b"\0", self.at)
        end = len(self.data) if end < 0 else end
        out, self.at = self.data[self.at : end], end + 1
        return out

    def nudge(self) -> None:
        if (self.u8(), self.u8()) == (128, 128):
            self.u16(), self.u16()

    def nibbles(self, n: int) -> None:
        """n values, each a unit, digits, and 15 as its end; two to a byte."""
        high = None

        def nibble() -> int:
            nonlocal high
            if high is None:
                b = self.u8()
                high = b & 15
                return b >> 4
            x, high = high, None
            return x

        for _ in range(n):
            nibble()
            while nibble() != 15:
                pass

    def ruler(self) -> None:
        for _ in range(self.u8()):
            self.u8(), self.u16()

    def header(self) -> None:
        version = self.u8()
        if version != 5:
            raise Void
        self.at += 4
        self.string()
        self.u8()

    def objects(self) -> list[Node]:
        """Records up to the list's end."""
        out: list[Node] = []
        while self.at < len(self.data):
            kind = self.u8()
            if kind == 0:
                break
            node = self.record(kind)
            if node is not None:
                out.append(node)
        return out

    def record(self, kind: int) -> Node | None:
        if kind >= 100:
            self.at += self.u8()
            return None
        if kind in (FULL, SUB, SUB2, SYM, SUBSYM):
            return None
        if kind in (COLOR,):
            self.u8()
        elif kind == FONT_STYLE:
            self.u8(), self.u8()
        elif kind == FONT_DEF:
            self.u8(), self.string()
        elif kind == ENCODING:
            self.string()
        elif kind == SIZE:
            b = self.u8()
            if b == 101:
                self.u16()
            elif b == 100:
                self.u8(), self.u16()
            else:
                self.u8()
        elif kind == COLOR_DEF:
            o = self.u8()
            self.at += 8 if o & 1 else 6
            if o & 4:
                self.string()
        elif kind == EQN_PREFS:
            self.u8()
            self.nibbles(self.u8())
            self.nibbles(self.u8())
            for _ in range(self.u8()):
                if self.u8():
                    self.u8()
        elif kind == RULER:
            self.ruler()
        else:
            return self.node(kind)
        return None

    def node(self, kind: int) -> Node:
        o = self.u8()
        if o & NUDGE:
            self.nudge()
        if kind == LINE:
            if o & LINE_SPACE:
                self.u8()
            if o & LP_RULER:
                self.ruler()
            return Node(LINE, (), [] if o & LINE_NULL else self.objects())
        if kind == CHAR:
            face = self.u8() - 128
            code = 0 if o & NO_MTCODE else self.u16()
            if o & CHAR_8:
                self.u8()
            if o & CHAR_16:
                self.u16()
            return Node(CHAR, (face, code), self.objects() if o & CHAR_EMBELL else [])
        if kind == EMBELL:
            return Node(EMBELL, (self.u8(),))
        if kind == TMPL:
            selector, v = self.u8(), self.u8()
            if v & 0x80:
                v = v & 0x7F | self.u8() << 8
            self.u8()
            return Node(TMPL, (selector, v), self.objects())
        if kind == PILE:
            self.u8(), self.u8()
            if o & LP_RULER:
                self.ruler()
            return Node(PILE, (), self.objects())
        if kind == MATRIX:
            self.at += 3
            rows, cols = self.u8(), self.u8()
            self.at += (rows + 1 + 3) // 4 + (cols + 1 + 3) // 4
            return Node(MATRIX, (rows, cols), self.objects())
        raise Void


def char(n: Node) -> str:
    face, code = n.value
    c = chr(code) if code and not 0xD800 <= code < 0xE000 else ""
    t = SIGNS.get(c) or ESCAPED.get(c) or greek(c) if c else ""
    t = c if t is None else t
    if t.startswith("\\") and t[-1:].isalpha():
        t += " "
    for e in n.items:
        if e.kind == EMBELL:
            k = e.value[0]
            if k in PRIMES:
                t = t.rstrip() + PRIMES[k]
            elif k in EMBELLISH:
                t = f"{EMBELLISH[k]}{{{t.strip()}}}"
            elif k == 10:
                t = rf"\not{t}"
            else:
                raise Void
    return t


def slots(n: Node) -> list[str]:
    return [latex(x.items) for x in n.items if x.kind in (LINE, PILE)] if all(x.kind != PILE for x in n.items) else [latex([x]) if x.kind == PILE else latex(x.items) for x in n.items if x.kind in (LINE, PILE)]


def scripts(sub: str, sup: str) -> str:
    return (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "")


def template(n: Node) -> str:
    kind, v = n.value
    s = slots(n)
    get = lambda k: s[k] if k < len(s) else ""
    if kind in FENCES:
        a, z = FENCES[kind]
        both = not v & 3
        return (a if v & 1 or both else r"\left.") + get(0) + (z if v & 2 or both else r"\right.")
    if kind == INTERVAL:
        side = lambda x: "()[]"[x & 3]
        return rf"\left{side(v)}{get(0)}\right{side(v >> 4)}"
    if kind == ROOT:
        return rf"\sqrt[{get(1)}]{{{get(0)}}}" if v == 1 and get(1) else rf"\sqrt{{{get(0)}}}"
    if kind == FRACT:
        return f"{get(0)}/{get(1)}" if v & 2 else rf"\frac{{{get(0)}}}{{{get(1)}}}"
    if kind in WRAP:
        return f"{WRAP[kind]}{{{get(0)}}}"
    if kind == ARROW:
        name = "xleftrightarrow" if v & 1 else "xleftarrow" if v & 16 else "xrightarrow"
        return rf"\{name}[{get(1)}]{{{get(0)}}}" if get(1) else rf"\{name}{{{get(0)}}}"
    if kind == INTEG:
        op = "\\" + ("oint" if v & 12 else "i" * max(1, v & 3) + "nt")
        return op + scripts(get(1), get(2)) + " " + get(0)
    if kind in BIG:
        return BIG[kind] + scripts(get(1), get(2)) + " " + get(0)
    if kind == LIM:
        op = get(0).replace(" ", "")
        op = "\\" + op if op in ("lim", "max", "min", "sup", "inf") else rf"\mathop{{{get(0)}}}"
        return op + scripts(get(1), get(2)) + " "
    if kind == HBRACE:
        return rf"\overbrace{{{get(0)}}}^{{{get(1)}}}" if v & 1 else rf"\underbrace{{{get(0)}}}_{{{get(1)}}}"
    if kind == T_SUB:
        return scripts(get(0), "")
    if kind == T_SUP:
        return scripts("", get(1) or get(0))
    if kind == T_SUBSUP:
        return scripts(get(0), get(1))
    raise Void


def latex(nodes: list[Node]) -> str:
    out = []
    for n in nodes:
        if n.kind == CHAR:
            out.append(char(n))
        elif n.kind == TMPL:
            out.append(template(n))
        elif n.kind == LINE:
            out.append(latex(n.items))
        elif n.kind == PILE:
            lines = [latex(x.items) for x in n.items if x.kind == LINE]
            out.append(r"\begin{array}{l}" + r" \\ ".join(lines) + r"\end{array}" if len(lines) > 1 else "".join(lines))
        elif n.kind == MATRIX:
            cells = [latex(x.items) for x in n.items if x.kind == LINE]
            cols = max(1, n.value[1])
            out.append(r"\begin{matrix}" + r" \\ ".join(" & ".join(cells[k : k + cols]) for k in range(0, len(cells), cols)) + r"\end{matrix}")
    return "".join(out)


def to_latex(data: bytes) -> str:
    """LaTeX of an equation's records; '' if they cannot be read or hold something without a rule."""
    import re

    try:
        r = Reader(data)
        r.header()
        nodes = []
        while r.at < len(data):
            nodes += r.objects()
        return re.sub(r"\s+", " ", latex(nodes)).strip().strip("$")
    except (Void, EOFError, struct.error, IndexError):
        return ""
