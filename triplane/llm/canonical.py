"""Canonical forms of utterances and queries, and their run over Arrow batches.

The forms take a handful of string passes each, about ten times less CPU in Python's string methods
than as chains of JVM regular expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Private-use characters that stand for what is content in an utterance: the signs and the decimal point of a number, and the gap between two numbers.
MINUS, POINT, GAP, PLUS = "", "", "", ""
#: Comparison signs, which are content too.
COMPARISONS = "<>=≤≥≠"


class _Kept(dict):
    """str.translate table: letters, marks, numbers and content signs stay, anything else goes."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = code if unicodedata.category(c)[0] in "LMN" or c in COMPARISONS or c in MINUS + POINT + GAP + PLUS else None
        return self[code]


_KEPT = _Kept()
_SIGN = re.compile(r"(?<![\w.,])[-−+](?=\.?\d)")
_POINT = re.compile(r"(?<=\d)\.(?=\d)")
_GAP = re.compile(rf"(?<=\d)[^\w{COMPARISONS}]*\s[^\w{COMPARISONS}]*(?=[\d{MINUS}{PLUS}])")
_DIGIT = re.compile(r"\d").search


def utterance_form(text: str) -> str:
    """Letters and digits only, in lower case, with the sign and decimal point of numbers and comparison signs kept.

    Numbers with white space between them stay apart. A text without letters, digits and comparison
    signs gives the empty string.
    """
    s = text.lower()
    if _DIGIT(s):
        s = _SIGN.sub(lambda m: PLUS if m[0] == "+" else MINUS, s)
        s = _GAP.sub(GAP, _POINT.sub(POINT, s))
    return s.translate(_KEPT)


_TOKEN = re.compile(
    r"""
    "(?:[^"\\]|\\.)*" | '(?:[^'\\]|\\.)*'                    # literals
    | <[^<>\s"{}|^`\\]*[:/][^<>\s"{}|^`\\]*>                  # IRIs; without a colon or slash it is a comparison
    | [?$]\w+ | [\w-]*:(?:[\w.%-]*[\w%-])? | @[a-zA-Z][\w-]*    # variables, prefixed names, languages
    | (?:\d+\.\d+|\.?\d+)(?:[eE][-+]?\d+)? | \w+              # numbers, words
    | \^\^ | && | \|\| | [!<>]= | \S
    """,
    re.VERBOSE,
).findall
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
#: Words that begin a part of a group that is no triple, and those of which the place in its group has a meaning.
KEYWORDS = frozenset("filter optional minus bind values graph service select".split())
PLACED = frozenset("optional minus bind".split())
#: Row limit that the queries' endpoint sets by itself.
DEFAULT_LIMIT = "1000"


#: Signs beside which white space says nothing.
TIGHT = "{}()<>=!&|,;./*^+-"


class _Group:
    """A group in braces: runs of elements, each run in any order (`free`) or kept. An element is a list of tokens and groups."""

    def __init__(self) -> None:
        self.runs: list[tuple[bool, list[list]]] = []

    def add(self, element: list, free: bool) -> None:
        if not self.runs or not free or not self.runs[-1][0]:
            self.runs.append((free, []))
        self.runs[-1][1].append(element)

    def elements(self) -> Iterator[list]:
        for _, run in self.runs:
            for element in run:
                yield element
                for x in element:
                    if isinstance(x, _Group):
                        yield from x.elements()

    def lines(self, name: Callable[[str], str], ordered: bool = True) -> list[str]:
        out = []
        for free, run in self.runs:
            shown = [_shown(e, name, ordered) for e in run]
            out += sorted(shown) if free and ordered else shown
        return out


def _shown(element: list, name: Callable[[str], str], ordered: bool = True) -> str:
    """An element as a text with a space only where no sign of TIGHT is beside it."""
    out = []
    for x in element:
        t = "{" + "\n".join(x.lines(name, ordered)) + "}" if isinstance(x, _Group) else name(x)
        if out and out[-1][-1] not in TIGHT and t[0] not in TIGHT:
            out.append(" ")
        out.append(t)
    return "".join(out)


def _cut(tokens: list, sign: str) -> list[list]:
    """Tokens cut at a sign outside brackets."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t in _OPEN) - (t in _CLOSE) if isinstance(t, str) else 0
        if t == sign and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _back(tokens: list, end: int) -> int:
    """Where the term begins that ends before `end`: a token, a literal with its type or language, a signed number, or something in brackets."""
    at = end - 1
    if at < 0:
        return 0
    if tokens[at] in _CLOSE:
        depth = 0
        while at >= 0:
            depth += (tokens[at] in _CLOSE) - (tokens[at] in _OPEN)
            if depth == 0:
                break
            at -= 1
        return max(at, 0)
    if at >= 2 and tokens[at - 1] == "^^":
        return at - 2
    if at >= 1 and (tokens[at][0] == "@" or tokens[at - 1] in ("-", "+") and tokens[at][0].isdigit()):
        return at - 1
    return at


def _triples(tokens: list) -> Iterator[list]:
    """The single statements of a statement with lists: of predicates, cut by semicolons, and of objects, cut by commas."""
    subject, verb = None, None
    for part in _cut(tokens, ";"):
        for obj in _cut(part, ","):
            if subject is None:
                n = 1
                if obj[0] in _OPEN:
                    depth = 0
                    for n, t in enumerate(obj, 1):
                        depth += (t in _OPEN) - (t in _CLOSE)
                        if depth == 0:
                            break
                subject, obj = obj[:n], obj[n:]
                verb = None
            if verb is None:
                cut = _back(obj, len(obj))
                verb, obj = obj[:cut], obj[cut:]
            yield [*subject, *verb, *obj]
        verb = None


class _Parser:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def bracketed(self) -> list:
        """Tokens up to the end of the bracket that begins here."""
        out, depth = [], 0
        while self.at < len(self.tokens):
            t = self.peek()
            if t == "{":
                self.at += 1
                out.append(self.group())
                continue
            depth += (t in _OPEN) - (t in _CLOSE)
            out.append(t)
            self.at += 1
            if depth <= 0:
                break
        return out

    def group(self) -> _Group:
        """A group, from after its brace to its end."""
        g = _Group()
        while (t := self.peek()) and t != "}":
            if t == ".":
                self.at += 1
            elif t == "{":
                element: list = []
                while self.peek() == "{":
                    self.at += 1
                    element.append(self.group())
                    if self.peek() == "union":
                        element.append("union")
                        self.at += 1
                g.add(element, True)
            elif t == "select":
                element = []
                while (t := self.peek()) and t != "}":
                    self.at += 1
                    element.append(self.group() if t == "{" else t)
                g.add(element, False)
            elif t in KEYWORDS:
                element = [t]
                self.at += 1
                while (t := self.peek()) and t not in ("{", "(", "}", "."):
                    element.append(t)
                    self.at += 1
                if t == "{":
                    self.at += 1
                    element.append(self.group())
                elif t == "(":
                    element += self.bracketed()
                    if element[0] == "values" and self.peek() == "{":
                        self.at += 1
                        element.append(self.group())
                g.add(element, element[0] not in PLACED)
            else:
                element, depth = [], 0
                while (t := self.peek()) and not (depth <= 0 and (t in (".", "{", "}") or t in KEYWORDS)):
                    depth += (t in _OPEN) - (t in _CLOSE)
                    element.append(t)
                    self.at += 1
                for triple in _triples(element):
                    g.add(triple, True)
        self.at += 1
        return g


def _parsed(tokens: list[str]) -> list:
    """A query as tokens and groups; with braces that don't match, as tokens only."""
    depth = 0
    for t in tokens:
        depth += (t == "{") - (t == "}")
        if depth < 0:
            break
    if depth:
        return tokens
    parser, out = _Parser(tokens), []
    while t := parser.peek():
        parser.at += 1
        out.append(parser.group() if t == "{" else t)
    return out


def _tokens(query: str) -> tuple[dict[str, str], list[str]]:
    """The prefixes that a query declares and its tokens, in lower case but for literals."""
    tokens = [t if t[0] in "\"'" and len(t) > 1 else t.lower() for t in _TOKEN(query)]
    prefixes, rest, n = {}, [], 0
    while n < len(tokens):
        if tokens[n] == "prefix" and n + 2 < len(tokens) and tokens[n + 1].endswith(":"):
            prefixes[tokens[n + 1]] = tokens[n + 2]
            n += 3
        else:
            rest.append(tokens[n])
            n += 1
    return prefixes, rest


_PREFIX = re.compile(r"prefix\s+([^\s<]*?)\s*(<[^>]*>)")
_END = re.compile(r"\.(?![0-9])")
_END_OUTSIDE_IRI = re.compile(r"\.(?![0-9])(?![^<>\s?(){}]*>)")
#: What a query must not have to be taken apart by its dots: literals, lists, other groups or parts that keep their place.
_NOT_FLAT = ("\"", "'", ";", ",", "[", "#", "? ", "bind", "optional", "minus", "values", "graph", "service", "union")


def _flat(query: str) -> tuple[dict[str, str], str, list[str], str] | None:
    """The prefixes, head, statements and tail of a query in lower case of one group of plain statements, as _parsed() gives them too; None for any other query."""
    s = query.lower()
    prefixes = {}
    if "prefix" in s:
        prefixes = dict(_PREFIX.findall(s))
        s = _PREFIX.sub(" ", s)
    if s.count("{") != 1 or s.count("}") != 1 or any(x in s for x in _NOT_FLAT):
        return None
    s = " ".join(s.split())
    for c in TIGHT:
        if c in s and c != ".":
            s = s.replace(f" {c}", c).replace(f"{c} ", c)
    head, _, rest = s.partition("{")
    inner, _, tail = rest.partition("}")
    parts = [p for p in map(str.strip, (_END_OUTSIDE_IRI if "<" in inner else _END).split(inner)) if p]
    if "filter" in inner and any("filter" in p and (p.count("filter") > 1 or not p.startswith("filter(") or p[-1] != ")" or p.count("(") != p.count(")")) for p in parts):
        return None
    return prefixes, head, parts, tail


def query_form(query: str, nested: bool = False) -> str:
    """A query without what differs in form only: letter case, white space, the order of prefixes and of statements, lists of predicates or objects.

    Literals, variable names, prefixes against full IRIs, numbers, operators and the side on which a term
    stands stay as they are. With `nested` the statements of every group are put in order, as far as no
    OPTIONAL, MINUS or BIND stands between them; without it a query with more than one group keeps its
    order. A blank query gives the empty string.
    """
    if flat := _flat(query):
        prefixes, head, parts, tail = flat
        return "\n".join([*sorted(k + v for k, v in prefixes.items()), head, *sorted(parts), tail])
    prefixes, tokens = _tokens(query)
    parts = _units(_parsed(tokens), str, nested or tokens.count("{") < 2)
    return "\n".join([*sorted(k + v for k, v in prefixes.items()), *parts]) if tokens or prefixes else ""


def _ends(parsed: list, name: Callable[[str], str]) -> str:
    """A query's head and tail."""
    at = next((i for i, x in enumerate(parsed) if isinstance(x, _Group)), len(parsed))
    return f"{_shown(parsed[:at], name)} {_shown([x for x in parsed[at:] if isinstance(x, str)], name)}"


def _units(parsed: list, name: Callable[[str], str], ordered: bool = True) -> list[str]:
    """A query's head, the lines of its group and its tail."""
    out, plain = [], []
    for x in parsed:
        if isinstance(x, _Group):
            out += [_shown(plain, name), *x.lines(name, ordered)]
            plain = []
        else:
            plain.append(x)
    return [*out, _shown(plain, name)]


#: The IRI paths of the graph's namespaces and their usual prefixes.
NAMESPACES = {"entity": "wd", "prop/direct": "wdt", "prop": "p", "prop/statement": "ps", "prop/qualifier": "pq"}
_IRI = re.compile(r"<[^<>\s]*/(entity|prop/direct|prop/statement|prop/qualifier|prop)/([^<>/\s]+)>").fullmatch


def _names(tokens: list[str], prefixes: dict[str, str]) -> Iterator[str]:
    """Tokens with full IRIs, and names under a declared prefix, as names under the usual prefixes."""
    for t in tokens:
        if t[0] not in "\"'<" and ":" in t:
            prefix, _, local = t.partition(":")
            if known := prefixes.get(f"{prefix}:"):
                full = f"{known[:-1]}{local}>"
                m = _IRI(full)
                t = f"{NAMESPACES[m[1]]}:{m[2]}" if m else full
        elif t[0] == "<" and len(t) > 2 and (m := _IRI(t)):
            t = f"{NAMESPACES[m[1]]}:{m[2]}"
        yield t


_VARIABLE = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[?$]\w+)""")


def _renamed(pieces: list[str], names: dict[str, str]) -> str:
    """A text, cut at its variables and literals, with the variables renamed."""
    return "".join([names.get(x, x) for x in pieces])


def _numbers(statements: list[list[str]]) -> dict[str, str]:
    """A name for each variable that depends on its part in the query only, not on its own name or the order of statements.

    Variables are told apart by the statements that they stand in, and then by what the other variables
    of those are, again and again while that tells more of them apart. What is still alike is numbered by
    first use in the order of the statements.
    """
    of: dict[str, list[list[str]]] = {}
    for s in statements:
        for x in set(s[1::2]):
            if x[0] in "?$":
                of.setdefault(x, []).append(s)
    if len(of) < 2:
        return dict.fromkeys(of, "?0")
    color, n = dict.fromkeys(of, "?"), 1
    while n < len(of):
        shown = {}
        for v, ss in of.items():
            names = color | {v: "?!"}
            shown[v] = "\n".join([color[v], *sorted([_renamed(s, names) for s in ss])])
        rank = {s: f"?{i}" for i, s in enumerate(sorted(set(shown.values())))}
        color = {v: rank[s] for v, s in shown.items()}
        if len(rank) == n:
            break
        n = len(rank)
    if n == len(of):
        return color
    text = " ".join(sorted(_renamed(s, {v: f"{c}\x00{v}\x00" for v, c in color.items()}) for s in statements))
    return {v: f"?{i}" for i, v in enumerate(sorted(color, key=lambda v: (color[v], text.find(f"\x00{v}\x00"))))}


def _usual_name(iri: str) -> tuple[str, str]:
    path, local = _IRI(iri).groups()
    return NAMESPACES[path], local


@lru_cache(None)
def _usual(prefix: str, iri: str) -> bool:
    m = _IRI(f"{iri[:-1]}x>")
    return bool(m) and NAMESPACES[m[1]] == prefix[:-1]


_FULL = re.compile(r"<[^<>\s]*/(?:entity|prop/direct|prop/statement|prop/qualifier|prop)/[^<>/\s]+>", re.IGNORECASE)
_DISTINCT = re.compile(r"(?<=[ (])distinct ?| ?distinct(?=\()")
_DEFAULT = re.compile(rf" ?limit {DEFAULT_LIMIT}(?!\w)")


@lru_cache(20_000)
def query_meaning(query: str) -> str:
    """What a query asks of which entities, properties and numbers: the ordered query_form, and besides that

    full IRIs and declared prefixes become usual names and prefix lines vanish, variables are numbered by
    the part that they play, and the words WHERE and DISTINCT and a limit of DEFAULT_LIMIT don't count.
    """
    if _FULL.search(query):
        query = _FULL.sub(lambda m: " {}:{} ".format(*_usual_name(m[0].lower())), query)
    flat = _flat(query)
    if flat and all(_usual(*x) for x in flat[0].items()):
        _, head, parts, tail = flat
        head = head.removesuffix("where").rstrip()
        head = _DISTINCT.sub("", head)
        tail = _DEFAULT.sub("", tail)
        cut = [_VARIABLE.split(x) for x in (f"{head} {tail}", *parts)]
        names = _numbers(cut)
        return "\n".join([_renamed(cut[0], names), *sorted([_renamed(p, names) for p in cut[1:]])])
    prefixes, tokens = _tokens(query)
    kept: list[str] = []
    for t in _names(tokens, prefixes):
        if t in ("where", "distinct"):
            continue
        if t == DEFAULT_LIMIT and kept[-1:] == ["limit"]:
            kept.pop()
            continue
        kept.append(t)
    parsed = _parsed(kept)
    inner = [_shown([x for x in e if isinstance(x, str)], str) for g in parsed if isinstance(g, _Group) for e in g.elements()]
    names = _numbers([_VARIABLE.split(x) for x in (_ends(parsed, str), *inner)])
    return "\n".join([_ends(parsed, lambda x: names.get(x, x)), *(line for g in parsed if isinstance(g, _Group) for line in g.lines(lambda x: names.get(x, x)))])


def hash128(text: str) -> bytes:
    """16 bytes that stand for a text; two texts share them with probability 2**-128."""
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def with_forms(rows: DataFrame, forms: dict[str, tuple[str, Callable[[str], str]]], hashed: set[str]) -> DataFrame:
    """`rows` with the text columns that `forms` names (column: (name, form)) replaced by their forms.

    A form in `hashed` comes as two integers, name1 and name2. Rows with a null text or an empty form
    are left out.
    """
    import pyarrow as pa

    passed = [f for f in rows.schema.fields if f.name not in forms]
    new = [T.StructField(n, t) for name, _ in forms.values() for n, t in ([(f"{name}1", T.LongType()), (f"{name}2", T.LongType())] if name in hashed else [(name, T.StringType())])]
    names, where = [f.name for f in [*passed, *new]], {f.name: i for i, f in enumerate(rows.schema.fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            kept, columns = np.ones(batch.num_rows, bool), []
            for column, (name, form) in forms.items():
                out = [form(x) if x else "" for x in batch.column(where[column]).to_pylist()]
                kept &= np.fromiter(map(bool, out), bool, len(out))
                columns.append((name, out))
            at = pa.array(np.flatnonzero(kept))
            arrays = [batch.column(where[f.name]).take(at) for f in passed]
            for name, out in columns:
                out = [out[i] for i in np.flatnonzero(kept)]
                if name in hashed:
                    pairs = np.frombuffer(b"".join(map(hash128, out)), np.int64).reshape(-1, 2)
                    arrays += [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
                else:
                    arrays.append(pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, T.StructType([*passed, *new]))
