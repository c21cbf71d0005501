"""Office equations as TeX."""

from __future__ import annotations

from xml.etree.ElementTree import Element

from .ooxml import NS, tag

#: What TeX calls these characters.
OPERATORS = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∮": r"\oint", "⋃": r"\bigcup", "⋂": r"\bigcap"}
ACCENTS = {"̂": r"\hat", "̃": r"\tilde", "̄": r"\bar", "̅": r"\overline", "̇": r"\dot", "̈": r"\ddot", "⃗": r"\vec"}
FUNCTIONS = frozenset(("arccos", "arcsin", "arctan", "cos", "cosh", "cot", "det", "exp", "gcd", "inf", "lim", "ln", "log", "max", "min", "sin", "sinh", "sup", "tan", "tanh"))


def tex(element: Element | None) -> str:
    """TeX of an equation or a part of one; parts of an unknown kind give what they hold."""
    if element is None:
        return ""
    kind = element.tag.rpartition("}")[2]
    if kind == "t":
        return element.text or ""
    if kind.endswith("Pr"):
        return ""
    part = lambda name: tex(element.find(f"m:{name}", NS))
    setting = lambda name, otherwise: _setting(element, name, otherwise)
    if kind == "f":
        return f"{part('num')}/{part('den')}" if setting("type", "bar") == "lin" else rf"\frac{{{part('num')}}}{{{part('den')}}}"
    if kind in ("sSup", "sSub", "sSubSup"):
        low, high = f"_{{{part('sub')}}}" if "Sub" in kind else "", f"^{{{part('sup')}}}" if kind.endswith("Sup") else ""
        return f"{{{part('e')}}}{low}{high}"
    if kind == "sPre":
        return f"{{}}_{{{part('sub')}}}^{{{part('sup')}}}{{{part('e')}}}"
    if kind == "rad":
        degree = part("deg")
        return rf"\sqrt{f'[{degree}]' if degree else ''}{{{part('e')}}}"
    if kind == "nary":
        sign = setting("chr", "∫")
        low, high = (f"{mark}{{{part(name)}}}" if part(name) else "" for mark, name in (("_", "sub"), ("^", "sup")))
        return f"{OPERATORS.get(sign, sign)}{low}{high}{{{part('e')}}}"
    if kind == "d":
        inner = setting("sepChr", "|").join(map(tex, element.findall("m:e", NS)))
        return rf"\left{_fence(setting('begChr', '('))}{inner}\right{_fence(setting('endChr', ')'))}"
    if kind == "func":
        name = part("fName")
        return f"{chr(92)}{name} {{{part('e')}}}" if name in FUNCTIONS else f"{name}{{{part('e')}}}"
    if kind in ("limLow", "limUpp"):
        return rf"\{'under' if kind == 'limLow' else 'over'}set{{{part('lim')}}}{{{part('e')}}}"
    if kind == "acc":
        return f"{ACCENTS.get(setting('chr', chr(0x302)), chr(92) + 'hat')}{{{part('e')}}}"
    if kind == "bar":
        return rf"\{'under' if setting('pos', 'bot') == 'bot' else 'over'}line{{{part('e')}}}"
    if kind == "m":
        rows = [" & ".join(map(tex, r.findall("m:e", NS))) for r in element.findall("m:mr", NS)]
        return rf"\begin{{matrix}}{r' \\ '.join(rows)}\end{{matrix}}"
    if kind == "eqArr":
        return rf"\begin{{aligned}}{r' \\ '.join(map(tex, element.findall('m:e', NS)))}\end{{aligned}}"
    return "".join(map(tex, element))


def _setting(element: Element, name: str, otherwise: str) -> str:
    found = next((s.find(f"m:{name}", NS) for s in element if s.tag.endswith("Pr") and s.find(f"m:{name}", NS) is not None), None)
    return otherwise if found is None else found.get(tag("m:val"), otherwise)


def _fence(sign: str) -> str:
    return {"": ".", "{": r"\{", "}": r"\}"}.get(sign, sign)
