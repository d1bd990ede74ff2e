"""Reading SMILES: cleaning of formatting, syntax check, parsing, and batch-wise graph hashes.

The reader is written against the public OpenSMILES description. Per-string work (cleaning and
parsing) is a single regular-expression scan; everything on graphs (largest part, ring core, colour
refinement) runs on flat numpy arrays over a whole Arrow batch of molecules at once.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# The chemical elements in order of atomic number, and the aromatic symbols.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb "
    "Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf "
    "Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
AROMATIC = ("b", "c", "n", "o", "p", "s", "se", "as", "te")
NUMBER = {e: i + 1 for i, e in enumerate(ELEMENTS)}
SYMBOL_ID = {**NUMBER, **{a: NUMBER[a.capitalize()] for a in AROMATIC}, "*": 0}

_SYMBOLS = sorted([*ELEMENTS, *AROMATIC, "*"], key=lambda e: (-len(e), e))
_TAIL = r"(?:@{1,2}|@(?:TH|AL)[12]|@SP[123]|@(?:TB|OH)\d{1,2})?(?:H\d?)?(?:\+{1,2}|-{1,2}|[+-]\d{1,2})?(?::\d{1,4})?"
_BRACKET = re.compile(r"(\d{1,3})?(" + "|".join(map(re.escape, _SYMBOLS)) + r")(" + _TAIL + r")\Z")
_TAIL_RE = re.compile(_TAIL + r"\Z")
_TOKEN = re.compile(r"\[([^\[\]]*)\]|(Cl|Br|[BCNOPSFI]|[bcnops]|\*)|(%\d\d|\d)|([-=#$:/\\])|([().])|(.)", re.S)

_PLAIN = re.compile(r"[A-Za-z0-9@+\-\[\]()=#$%./\\:*]*\Z")
_RECASE = re.compile(r"\[[^\[\]]*\]|[cC][lL]|[bB][rR]|f|i")
_START = re.compile(r"[A-Za-z\[*]")
_END = re.compile(r"[A-Za-z0-9\])*]")

BOND = {"-": 1, "/": 1, "\\": 1, "=": 2, "#": 3, "$": 4, ":": 5}
AROMATIC_BOND = 5


def _visible(s: str) -> str:
    return "".join(c for c in s if not c.isspace() and unicodedata.category(c)[0] not in "CZ")


def _recase_bracket(body: str) -> str:
    """The only valid reading of a bracket atom's letters, or the body as it is."""
    if _BRACKET.match(body):
        return body
    m = re.match(r"(\d{0,3})([A-Za-z]+)(.*)\Z", body, re.S)
    if not m:
        return body
    iso, letters, rest = m.groups()
    found = set()
    for n in (1, 2):
        if len(letters) < n:
            continue
        head, tail = letters[:n], letters[n:]
        spellings = {head.capitalize(), head.lower()} & set(SYMBOL_ID)
        for tail_case in {tail, tail.upper()}:
            if _TAIL_RE.match(tail_case + rest):
                found |= {iso + sp + tail_case + rest for sp in spellings}
    return found.pop() if len(found) == 1 else body


def _recase(m: re.Match) -> str:
    t = m.group(0)
    if t[0] == "[":
        return "[" + _recase_bracket(t[1:-1]) + "]"
    return t.capitalize()


def clean(s: str | None) -> str | None:
    """A SMILES without its formatting; None for null, "" where nothing is left.

    Removes white space and invisible signs anywhere and punctuation around the string, and mends
    letter case where only one reading is a valid element (``CL`` is chlorine, ``CN`` stays).
    Everything that belongs to the SMILES is kept, also the order of its parts.
    """
    if s is None:
        return None
    if not _PLAIN.match(s):
        s = _visible(s)
    before = None
    while s != before:  # until nothing is left to strip
        before = s
        a, b = 0, len(s)
        while a < b and not _START.match(s[a]):
            a += 1
        while b > a and not _END.match(s[b - 1]):
            b -= 1
        s = s[a:b]
        if s and s[-1] in ")]" and s.count(s[-1]) > s.count("(" if s[-1] == ")" else "["):
            s = s[:-1]
    if s[:1] == "[" and s[-1:] == "]":  # a pair around the whole, if it can't be an atom
        inner = s[1:-1]
        if not _BRACKET.match(_recase_bracket(s[1 : s.index("]")])) and "[" not in inner.split("]")[0]:
            if parse(inner) is not None:
                s = inner
    return _RECASE.sub(_recase, s)


def canonical_text(s: str | None) -> str | None:
    """``clean`` with the dot-separated parts in byte order: equal for copies, else different.

    Empty parts (doubled dots) are formatting too. Null and empty give None.
    """
    t = clean(s)
    if not t:
        return None
    if "." in t:
        t = ".".join(sorted(p for p in t.split(".") if p))
    return t or None


class Molecule:
    """Atoms and bonds of one SMILES. ``part`` numbers the connected parts."""

    __slots__ = ("aromatic", "bonds", "element", "part", "parts")

    def __init__(self, element: list[int], aromatic: list[bool], bonds: list[tuple[int, int, int, bool]], part: list[int], parts: int):
        self.element, self.aromatic, self.bonds, self.part, self.parts = element, aromatic, bonds, part, parts


def parse(s: str) -> Molecule | None:
    """The molecule of a SMILES, or None if the string isn't one by syntax. Valence isn't checked.

    Bonds are (atom, atom, order, in a ring); order 5 is aromatic. An unmarked bond between aromatic
    atoms is aromatic within a ring and single otherwise.
    """
    if not s:
        return None
    element: list[int] = []
    aromatic: list[bool] = []
    parent: list[int] = []
    depth: list[int] = []
    up: list[int] = []  # order of the bond to the parent, 0 if unmarked
    part: list[int] = []
    merge: list[tuple[int, int]] = []
    closures: list[tuple[int, int, int]] = []
    open_rings: dict[str, tuple[int, int]] = {}
    stack: list[int] = []
    prev, pending, last, parts = -1, 0, "", 0
    for m in _TOKEN.finditer(s):
        k = m.lastindex
        if k == 2 or k == 1:
            if k == 2:
                sym = m.group(2)
            else:
                b = _BRACKET.match(m.group(1))
                if b is None:
                    return None
                sym = b.group(2)
            at = len(element)
            element.append(SYMBOL_ID[sym])
            aromatic.append(sym.islower())
            parent.append(prev)
            up.append(pending)
            if prev < 0:
                depth.append(0)
                part.append(parts)
                parts += 1
            else:
                depth.append(depth[prev] + 1)
                part.append(part[prev])
            prev, pending, last = at, 0, "a"
        elif k == 3:
            if last not in ("a", "r", ")", "b") or prev < 0:
                return None
            label = m.group(3).lstrip("%").lstrip("0") or "0"
            if label in open_rings:
                other, order = open_rings.pop(label)
                if other == prev or parent[prev] == other or parent[other] == prev or (order and pending and order != pending):
                    return None
                closures.append((other, prev, order or pending))
                if part[other] != part[prev]:
                    merge.append((part[other], part[prev]))
            else:
                open_rings[label] = (prev, pending)
            pending, last = 0, "r"
        elif k == 4:
            if last not in ("a", "r", ")", "("):
                return None
            pending, last = BOND[m.group(4)], "b"
        elif k == 5:
            c = m.group(5)
            if c == "(":
                if last not in ("a", "r", ")") or prev < 0:
                    return None
                stack.append(prev)
                last = "("
            elif c == ")":
                if last not in ("a", "r", ")") or not stack:
                    return None
                prev, last = stack.pop(), ")"
            else:
                if last not in ("a", "r", ")"):
                    return None
                prev, last = -1, "."
        else:
            return None
    if last not in ("a", "r", ")") or stack or open_rings:
        return None
    pairs = {(min(a, b), max(a, b)) for a, b, _ in closures}
    if len(pairs) != len(closures):
        return None
    ring_up = [False] * len(element)
    if merge:  # closures between parts written apart may be plain bonds, so rings are looked for one by one
        part, parts = _merged(part, merge)
        ends = [(u, v) for v, u in enumerate(parent) if u >= 0] + [(a, b) for a, b, _ in closures]
        in_ring = [_linked(ends[:i] + ends[i + 1 :], u, v) for i, (u, v) in enumerate(ends)]
        orders = [up[v] for v, u in enumerate(parent) if u >= 0] + [o for _, _, o in closures]
        return Molecule(element, aromatic, [(u, v, o or (AROMATIC_BOND if r and aromatic[u] and aromatic[v] else 1), r) for (u, v), o, r in zip(ends, orders, in_ring)], part, parts)
    for a, b, _ in closures:
        while a != b:
            if depth[a] < depth[b]:
                a, b = b, a
            ring_up[a] = True
            a = parent[a]
    bonds = []
    for v, u in enumerate(parent):
        if u >= 0:
            bonds.append((u, v, up[v] or (AROMATIC_BOND if ring_up[v] and aromatic[u] and aromatic[v] else 1), ring_up[v]))
    for a, b, order in closures:
        bonds.append((a, b, order or (AROMATIC_BOND if aromatic[a] and aromatic[b] else 1), True))
    return Molecule(element, aromatic, bonds, part, parts)


def _linked(bonds: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether bonds lead from a to b."""
    near: dict[int, list[int]] = {}
    for u, v in bonds:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    seen, todo = {a}, [a]
    while todo:
        for v in near.get(todo.pop(), ()):
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return b in seen


def _merged(part: list[int], merge: list[tuple[int, int]]) -> tuple[list[int], int]:
    root = {p: p for p in part}
    for a, b in merge:
        ra, rb = root[a], root[b]
        root = {k: ra if v == rb else v for k, v in root.items()}
    names = {r: i for i, r in enumerate(sorted(set(root.values())))}
    return [names[root[p]] for p in part], len(names)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Graphs:
    """Largest parts of a batch of molecules as flat arrays, hydrogens left out.

    ``mol``: molecule of each atom; ``a``, ``b``: atoms of each bond; ``count``: molecules.
    """

    def __init__(self, mols: list[Molecule | None]):
        self.count = len(mols)
        mol, elem, arom, part, a, b, order, ring = [], [], [], [], [], [], [], []
        base = parts = 0
        for i, m in enumerate(mols):
            if m is None:
                continue
            n = len(m.element)
            mol.extend([i] * n)
            elem.extend(m.element)
            arom.extend(m.aromatic)
            part.extend([parts + p for p in m.part])
            for u, v, o, r in m.bonds:
                a.append(base + u)
                b.append(base + v)
                order.append(o)
                ring.append(r)
            base += n
            parts += m.parts
        self.mol, self.elem = np.array(mol, np.int64), np.array(elem, np.int64)
        self.arom, self.part = np.array(arom, bool), np.array(part, np.int64)
        self.a, self.b = np.array(a, np.int64), np.array(b, np.int64)
        self.order, self.ring = np.array(order, np.int64), np.array(ring, bool)
        self.parts = parts
        self._keep(self.elem != 1)
        self._largest()

    def _keep(self, atoms: np.ndarray) -> None:
        new = np.cumsum(atoms) - 1
        bonds = atoms[self.a] & atoms[self.b]
        self.a, self.b, self.order, self.ring = new[self.a[bonds]], new[self.b[bonds]], self.order[bonds], self.ring[bonds]
        self.mol, self.elem, self.arom, self.part = self.mol[atoms], self.elem[atoms], self.arom[atoms], self.part[atoms]

    def _largest(self) -> None:
        """Keep each molecule's part of most atoms; of equal ones, the one of the smallest hash."""
        if not len(self.mol):
            return
        size = np.bincount(self.part, minlength=self.parts)
        of = np.full(self.parts, -1, np.int64)
        of[self.part] = self.mol
        best = np.zeros(self.count, np.int64)
        np.maximum.at(best, of[of >= 0], size[of >= 0])
        top = (of >= 0) & (size == best[of])
        per = np.bincount(of[top], minlength=self.count)
        if (per > 1).any():
            h = self.hashes(group=self.part, groups=self.parts)[0]
            low = np.full(self.count, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(low, of[top], h[top])
            top &= h == low[of]
            first = np.full(self.count, self.parts, np.int64)
            np.minimum.at(first, of[top], np.flatnonzero(top))
            chosen = np.zeros(self.parts, bool)
            chosen[first[first < self.parts]] = True
            top &= chosen
        self._keep(top[self.part])

    def ring_core(self) -> None:
        """Cut to rings and the chains linking them: remove ends until none is left."""
        while len(self.mol):
            deg = np.bincount(self.a, minlength=len(self.mol)) + np.bincount(self.b, minlength=len(self.mol))
            keep = deg > 1
            if keep.all():
                return
            self._keep(keep)

    def hashes(self, group: np.ndarray | None = None, groups: int | None = None, radii: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        """(hash of each group's graph, atom colours after each of ``radii`` rounds).

        Colour refinement over (element, aromatic) and (bond order, ring bond), until a group's colours
        tell no more atoms apart. The result doesn't depend on the order of atoms nor on the rest of the
        batch. Refinement doesn't tell apart all graphs (some regular ones have equal colours).
        """
        group = self.mol if group is None else group
        groups = self.count if groups is None else groups
        size = np.bincount(group, minlength=groups) if len(group) else np.zeros(groups, np.int64)
        colour = mix(self.elem * 2 + self.arom)
        kind = mix(self.order * 2 + self.ring)
        a, b, k = self.a, self.b, kind
        kept = [colour.copy()] if 0 in radii else []
        total = np.zeros(groups, np.uint64)
        with np.errstate(over="ignore"):
            classes, going, r, least = self._distinct(group, groups, colour), size > 0, 0, max(radii, default=0)
            while len(colour) and (going.any() or r < least):
                r += 1
                around = np.zeros(len(colour), np.uint64)
                np.add.at(around, a, mix(colour[b] ^ k))
                np.add.at(around, b, mix(colour[a] ^ k))
                fresh = mix(colour * np.uint64(3) + around)
                if r <= least:  # terms of all radii, then each group on its own
                    colour = fresh
                    if r in radii:
                        kept.append(colour.copy())
                else:
                    colour = np.where(going[group], fresh, colour)
                now = self._distinct(group, groups, colour)
                going = going & ((now > classes) | (r <= least))
                classes = now
            kept += [colour.copy()] * (len(radii) - len(kept))
            np.add.at(total, group, mix(colour))
            total = mix(total + mix(size))
        return total, kept

    @staticmethod
    def _distinct(group: np.ndarray, groups: int, colour: np.ndarray) -> np.ndarray:
        """How many colours each group has."""
        order = np.lexsort((colour, group))
        g, c = group[order], colour[order]
        first = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])] if len(g) else np.zeros(0, bool)
        return np.bincount(g[first], minlength=groups)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
