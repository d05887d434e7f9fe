"""Office math to LaTeX."""

from __future__ import annotations

from xml.etree import ElementTree as ET

from .xml import attr, child, children, name, text

# Signs, n-ary operators, delimiters, functions and accents.
SIGNS = dict(x.split(" ", 1) for x in r"""× \times
÷ \div
± \pm
∓ \mp
≤ \leq
≥ \geq
≠ \neq
≈ \approx
∞ \infty
∑ \sum
∏ \prod
∫ \int
∂ \partial
∇ \nabla
√ \sqrt
∀ \forall
∈ \in
∉ \notin
⊂ \subset
⊃ \supset
⊆ \subseteq
⊇ \supseteq
∪ \cup
∩ \cap
∧ \wedge
∨ \vee
¬ \neg
→ \rightarrow
← \leftarrow
↔ \leftrightarrow
⇒ \Rightarrow
⇐ \Leftarrow
⇔ \Leftrightarrow""".split("\n"))
SPACED = "∀∈∉"  # these are followed by a blank
NARY = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "⋃": r"\bigcup", "⋂": r"\bigcap"}
OPEN = {"(": r"\left(", "[": r"\left[", "{": r"\left\{", "|": r"\left|", "⟨": r"\left\langle", "‖": r"\left\|", "": ""}
CLOSE = {")": r"\right)", "]": r"\right]", "}": r"\right\}", "|": r"\right|", "⟩": r"\right\rangle", "‖": r"\right\|", "": r"\right."}
MATRIX = {"[]": "bmatrix", "()": "pmatrix", "{}": "Bmatrix", "||": "vmatrix", "‖‖": "Vmatrix"}
FUNCTIONS = "sin cos tan cot sec csc sinh cosh tanh log ln exp lim max min sup inf det dim arg".split()
ACCENTS = {"̂": "hat", "̃": "tilde", "̄": "bar", "́": "acute", "̀": "grave", "̇": "dot", "̈": "ddot", "̆": "breve", "̌": "check", "⃗": "vec", "^": "hat", "~": "tilde", "¯": "bar", "→": "vec"}


def greek(c: str) -> str | None:
    """LaTeX's name of a Greek letter, from the letter's own name; capitals only where they differ from Latin ones."""
    import unicodedata

    words = unicodedata.name(c, "").split()
    if words[:1] != ["GREEK"] or len(words) != 4 or words[2] != "LETTER":
        return None
    n = {"LAMDA": "lambda", "FINAL": "varsigma"}.get(words[3], words[3].lower())
    if n == "omicron" or words[1] == "CAPITAL" and n not in "gamma delta theta lambda xi pi sigma upsilon phi psi omega".split():
        return None
    return "\\" + (n.capitalize() if words[1] == "CAPITAL" else n)


def sign(c: str) -> str:
    if c in SIGNS:
        return SIGNS[c] + " " * (c in SPACED)
    return greek(c) or ("\\" + c if c in "#$%&_{}" else c)


def run(e: ET.Element) -> str:
    return "".join(map(sign, "".join(text(t) for t in children(e, "t"))))


def part(e: ET.Element, tag: str) -> str:
    c = child(e, tag)
    return "" if c is None else latex(c)


def value(e: ET.Element, *path: str, default: str = "") -> str:
    c = child(e, *path)
    return default if c is None else attr(c, "val", "") or ""


def grid(m: ET.Element) -> str:
    return r" \\ ".join(" & ".join(latex(e) for e in children(r, "e")) for r in children(m, "mr"))


def delimited(d: ET.Element) -> str:
    a, z = value(d, "dPr", "begChr", default="("), value(d, "dPr", "endChr", default=")")
    inner = children(d, "e")
    if len(inner) == 1:
        m = child(inner[0], "m")
        if m is not None:
            env = MATRIX.get(a + z, "matrix")
            return rf"\begin{{{env}}}{grid(m)}\end{{{env}}}"
        f = child(inner[0], "f")
        if f is not None and (a, z) == ("(", ")") and value(f, "fPr", "type") == "noBar":
            return fraction(f)
    return OPEN.get(a, rf"\left{a}") + ", ".join(map(latex, inner)) + CLOSE.get(z, rf"\right{z}")


def fraction(f: ET.Element) -> str:
    n, d = part(f, "num"), part(f, "den")
    kind = value(f, "fPr", "type", default="bar")
    if kind == "noBar":
        return rf"\binom{{{n}}}{{{d}}}"
    return f"{n}/{d}" if kind == "lin" else rf"\frac{{{n}}}{{{d}}}"


def radical(r: ET.Element) -> str:
    degree = part(r, "deg")
    return rf"\sqrt[{degree}]{{{part(r, 'e')}}}" if degree else rf"\sqrt{{{part(r, 'e')}}}"


def nary(n: ET.Element) -> str:
    op = NARY.get(value(n, "naryPr", "chr"), r"\int")
    sub, sup = part(n, "sub"), part(n, "sup")
    return op + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "") + " " + part(n, "e")


def function(f: ET.Element) -> str:
    n = part(f, "fName")
    return ("\\" + n.strip().lower() if n.strip().lower() in FUNCTIONS else n) + " " + part(f, "e")


def stacked(a: ET.Element) -> str:
    lines = [latex(e) for e in children(a, "e")]
    return r"\begin{aligned}" + r" \\ ".join(lines) + r"\end{aligned}" if len(lines) > 1 else "".join(lines)


def grouped(g: ET.Element) -> str:
    brace = {"⏟": "underbrace", "⏞": "overbrace"}.get(value(g, "groupChrPr", "chr"))
    return rf"\{brace}{{{part(g, 'e')}}}" if brace else part(g, "e")


BUILD = {
    "r": run, "f": fraction, "rad": radical, "nary": nary, "d": delimited, "func": function, "eqArr": stacked, "groupChr": grouped,
    "m": lambda e: r"\begin{pmatrix}" + grid(e) + r"\end{pmatrix}",
    "sSup": lambda e: f"{{{part(e, 'e')}}}^{{{part(e, 'sup')}}}",
    "sSub": lambda e: f"{{{part(e, 'e')}}}_{{{part(e, 'sub')}}}",
    "sSubSup": lambda e: f"{{{part(e, 'e')}}}_{{{part(e, 'sub')}}}^{{{part(e, 'sup')}}}",
    "limLow": lambda e: f"{part(e, 'e')}_{{{part(e, 'lim')}}}",
    "limUpp": lambda e: f"{part(e, 'e')}^{{{part(e, 'lim')}}}",
    "acc": lambda e: rf"\{ACCENTS.get(value(e, 'accPr', 'chr', default='^'), 'hat')}{{{part(e, 'e')}}}",
    "bar": lambda e: rf"\overline{{{part(e, 'e')}}}",
}


def latex(e: ET.Element) -> str:
    """LaTeX of an element's children; elements without a rule of their own give that of their children."""
    return "".join(BUILD.get(name(c), latex)(c) for c in e)


def formulas(root: ET.Element) -> list[tuple[int, str, bool]]:
    """(index, LaTeX, whether it stands alone) of each formula of a document; blank ones are left out."""
    blocks = {id(m) for p in root.iter() if name(p) == "oMathPara" for m in p.iter() if name(m) == "oMath"}
    found = [(latex(m), id(m) in blocks) for m in root.iter() if name(m) == "oMath"]
    return [(k, t, b) for k, (t, b) in enumerate(x for x in found if x[0].strip())]
