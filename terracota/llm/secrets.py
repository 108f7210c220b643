"""Secrets by one automaton for all rules: subset construction, minimisation, transition arrays, one pass over the bytes.

The rules' regular expressions (over ASCII bytes) become one nondeterministic automaton with a loop at its start, then a
deterministic one whose states carry the set of rules that match up to here, then the smallest such one. A batch of texts is
one array of bytes, cut into lanes that step through the transition array side by side. A lane starts as if after a
text's end; where the lane before it ends in another state, it steps again until both runs agree.

The pass gives the ends of matches. A match's start comes from a walk back with the rule's reversed automaton, its
full length from a walk forward with the rule's own, for the few texts that have any. Spans are leftmost, longest
and don't overlap within a rule, which equals the regular expressions' own greedy matching for rules in
which no match can lie inside another's fixed prefix, as here. Offsets are code points, ends exclusive.

Of rules with a long body the search automaton holds only the fixed beginning, so the beginnings of all rules share one small trie-like machine: with
the bodies in it, each set of bodies that may run at once would be a state of its own. The body is read by the rule's own automaton where a beginning was found.

Cases: null and empty texts have no secrets; the separator between texts is a byte that UTF-8 never has; a very long text is read in
blocks of BLOCK bytes, each from the state that the one before it ended in, so the pass needs some bytes a byte of a block; rows that
repeat are answered row by row; spans of different rules that tie in their start come in the rules' order; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracota.llm.common import by_text, shared

LANES, SEPARATOR, BLOCK = 4096, 0xFF, 1 << 22
ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1  # bytes that the part after prefix must have
    prefix: str = ""  # cut off before least is applied
    whole: str = ""  # what a match goes on to, if it is more than pattern, which begins it; the search needs pattern alone
    alone: bool = False  # no letter or digit before it


#: A private key: its header, and all up to its END line if no other five dashes come before that; else (a key whose end is
#: missing) the base64 after the header in runs of 16 and more and a shorter last one, over line ends (also written-out ones, with
#: quotes' marks or indents) or blanks.
_KEY = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:\x20|\t|\r|\n|\\r|\\n)[\x20\t\r\n>#*|]*"
HEADER = rf"-----BEGIN {_KEY}"
WHOLE = rf"{HEADER}(?:(?:[\x00-,.-\xFE]|-{{1,4}}[\x00-,.-\xFE])*-----END {_KEY}|(?:(?:{_BREAK})?[A-Za-z0-9+/=]{{16,}})+(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}={{1,2}})?)?"



_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""


def token(kind: str, prefix: str, body: str, first: str = "") -> Rule:
    """A published token format: a fixed prefix, then body. first: how a body begins, for the search; by default any letter, digit, - or _."""
    return Rule(kind, prefix + (first or r"[A-Za-z0-9_-]"), whole=prefix + body, alone=True)


_URL, _CREDENTIALS = r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|mongodb\+srv|rediss?|amqps?|smtps?|ldaps?|mssql)://", r"[A-Za-z0-9._%+~-]+:[!#-&(-.0-9;=?A-~]+@[A-Za-z0-9]"
_AWS = r"""[aA][wW][sS]_[sS][eE][cC][rR][eE][tT]_[aA][cC][cC][eE][sS][sS]_[kK][eE][yY]["']?\x20*[:=]?\x20*["']?"""

#: Token formats as their services publish them. Fixed values.
TOKENS = (
    token("aws", "ASIA", r"[A-Z0-9]{16,}", "[A-Z0-9]"),
    token("slack", "xox[abeoprs]-", r"[A-Za-z0-9-]{10,}"),
    token("slack", "xapp-[0-9]-", r"[A-Za-z0-9-]{20,}"),
    token("slack", "hooks[.]slack[.]com/services/", r"T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{16,}", "T"),
    token("stripe", "[rs]k_(?:live|test)_", r"[A-Za-z0-9]{16,}"),
    token("stripe", "whsec_", r"[A-Za-z0-9+/]{32,}={0,2}", "[A-Za-z0-9+/]"),
    token("google", "AIza", r"[A-Za-z0-9_-]{35,}"),
    token("google", "GOCSPX-", r"[A-Za-z0-9_-]{28,}"),
    token("google", "ya29[.]", r"[A-Za-z0-9_-]{20,}"),
    token("jwt", "eyJ", r"[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    token("gitlab", "gl(?:pat|ptt|dt|rt|cbt|soat)-", r"[A-Za-z0-9_-]{20,}"),
    token("npm", "npm_", r"[A-Za-z0-9]{36,}"),
    token("pypi", "pypi-AgE", r"[A-Za-z0-9_-]{50,}"),
    token("rubygems", "rubygems_", r"[a-f0-9]{48,}"),
    token("docker", "dckr_pat_", r"[A-Za-z0-9_-]{27,}"),
    token("digitalocean", "do[opr]_v1_", r"[a-f0-9]{64,}"),
    token("sendgrid", "SG[.]", r"[A-Za-z0-9_-]{16,}[.][A-Za-z0-9_-]{32,}"),
    token("huggingface", "hf_", r"[A-Za-z0-9]{34,}"),
    token("openai", "sk-(?:proj-|svcacct-)?", r"[A-Za-z0-9_-]{32,}"),
    token("shopify", "shp(?:at|ca|pa|ss)_", r"[a-fA-F0-9]{32,}"),
    token("square", "sq0(?:atp|csp|idp)-", r"[A-Za-z0-9_-]{22,}"),
    token("twilio", "SK", r"[0-9a-f]{32,}", "[0-9a-f]"),
    token("mailgun", "key-", r"[0-9a-f]{32,}", "[0-9a-f]"),
    token("telegram", "[0-9]{8,10}:AA", r"[A-Za-z0-9_-]{33,}"),
    token("facebook", "EAACEdEose0cBA", r"[A-Za-z0-9]{10,}"),
    token("age", "AGE-SECRET-KEY-1", r"[A-Z0-9]{58,}"),
    token("atlassian", "ATATT3", r"[A-Za-z0-9_=-]{60,}", "[A-Za-z0-9_=-]"),
    token("linear", "lin_api_", r"[A-Za-z0-9]{40,}"),
    token("newrelic", "NRAK-", r"[A-Z0-9]{27,}"),
    token("grafana", "glsa_", r"[A-Za-z0-9]{32,}_[a-fA-F0-9]{8,}"),
    token("vault", "hv[bs][.]", r"[A-Za-z0-9_-]{24,}"),
    token("databricks", "dapi", r"[a-f0-9]{32,}", "[a-f0-9]"),
    token("pulumi", "pul-", r"[a-f0-9]{40,}", "[a-f0-9]"),
    token("postman", "PMAK-", r"[a-f0-9]{24,}-[a-f0-9]{34,}"),
    token("figma", "figd_", r"[A-Za-z0-9_-]{40,}"),
    token("azure", "AccountKey=", r"[A-Za-z0-9+/]{80,}={0,2}", "[A-Za-z0-9+/]"),
    Rule("aws", _AWS + "[A-Za-z0-9+/]", whole=_AWS + "[A-Za-z0-9+/]{40,}={0,2}"),
    Rule("url", f"{_URL}[A-Za-z0-9._%+~-]", whole=f"{_URL}{_CREDENTIALS}[A-Za-z0-9.-]*", alone=True),
)

#: The three base kinds of the contract first; those after it are the method's own. Fixed values.
RULES = (
    Rule("assign", _ASSIGN, 6, r"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?""", _ASSIGN + "*"),
    Rule("access", "AKIA[A-Z0-9]", 20, whole="AKIA[A-Z0-9]+"),
    Rule("hex", "[0-9a-f]{24}", whole="[0-9a-f]{24,}"),
    Rule("pem", HEADER, whole=WHOLE),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]", 40, whole="gh[oprsu]_[A-Za-z0-9]+"),
    Rule("github", "github_pat_[A-Za-z0-9_]", 93, whole="github_pat_[A-Za-z0-9_]+"),
    *TOKENS,
)


class Automaton:
    """The smallest deterministic automaton of patterns. searching: matches may begin anywhere."""

    def __init__(self, patterns: list[str], searching: bool, reverse: bool = False):
        self.edges: list[list[tuple[int | None, frozenset | None]]] = [[]]
        ends = {}
        for number, pattern in enumerate(patterns):
            ends.setdefault(self._add(parser.parse(pattern), 0, reverse), set()).add(number)
        symbols = self._classes()
        self._subsets(ends, symbols, searching)
        self._minimise()

    def _node(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _link(self, a: int, b: int, on: frozenset | None = None) -> int:
        self.edges[a].append((b, on))
        return b

    def _add(self, items, at: int, reverse: bool) -> int:
        at = self._link(at, self._node())
        for op, arg in reversed(list(items)) if reverse else items:
            if op is parser.LITERAL:
                at = self._link(at, self._node(), frozenset([arg]))
            elif op is parser.IN:
                at = self._link(at, self._node(), frozenset(b for kind, x in arg for b in ([x] if kind is parser.LITERAL else range(x[0], x[1] + 1) if kind is parser.RANGE else [][0])))
            elif op is parser.SUBPATTERN:
                at = self._add(arg[3], at, reverse)
            elif op is parser.BRANCH:
                joined = self._node()
                for option in arg[1]:
                    self._link(self._add(option, at, reverse), joined)
                at = joined
            elif op is parser.MAX_REPEAT:
                least, most, item = arg
                for _ in range(least):
                    at = self._add(item, at, reverse)
                if most is parser.MAXREPEAT:
                    loop = self._link(at, self._node())
                    self._link(self._add(item, loop, reverse), loop)
                    at = self._link(loop, self._node())
                else:
                    exits = [at]
                    for _ in range(most - least):
                        exits.append(at := self._add(item, at, reverse))
                    at = reduce(lambda end, e: self._link(e, end), exits, self._node())
            else:
                raise ValueError(f"rules have no {op}")
        return at

    def _classes(self) -> list[int]:
        """Bytes that no rule tells apart share a class; self.of: class of each byte. A sample byte of each class."""
        sets = {on for out in self.edges for _, on in out if on}
        seen: dict[tuple, int] = {}
        self.of = np.array([seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)], np.uint8)
        return [int(np.argmax(self.of == c)) for c in range(len(seen))]

    def _closure(self, nodes: set[int]) -> frozenset[int]:
        todo, seen = list(nodes), set(nodes)
        while todo:
            for b, on in self.edges[todo.pop()]:
                if on is None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    def _subsets(self, ends: dict, symbols: list[int], searching: bool) -> None:
        """States are sets of nodes, as bits of a whole number; each node's steps are worked out once."""
        bits = lambda nodes: sum(1 << n for n in nodes)
        start = bits(self._closure({0}))
        steps: dict[int, list[tuple[list[int], int]]] = {}
        for n, out in enumerate(self.edges):
            if own := [([c for c, b in enumerate(symbols) if b in on], bits(self._closure({to}))) for to, on in out if on is not None]:
                steps[n] = own
        moving, final = bits(steps), bits(ends)
        numbers, todo, self.next, self.accept = {start: 0}, [start], [], []
        nodes = lambda m: [i for i, c in enumerate(reversed(bin(m)[2:])) if c == "1"]
        for state in todo:  # grows
            self.accept.append(frozenset(r for n in nodes(state & final) for r in ends[n]))
            row = [start if searching else 0] * len(symbols)
            for n in nodes(state & moving):
                for classes, to in steps[n]:
                    for c in classes:
                        row[c] |= to
            for to in row:
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
            self.next.append([numbers[to] for to in row])

    def _minimise(self) -> None:
        """Splits the states by what they accept, then by the groups that their steps lead to, until no group splits."""
        step = np.array(self.next)
        kinds = {a: i for i, a in enumerate(dict.fromkeys(self.accept))}
        group = np.array([kinds[a] for a in self.accept])
        while True:
            _, new = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)
            if new.max() == group.max():
                break
            group = new.reshape(-1)
        group = group.reshape(-1)
        group = np.where(group == group[0], 0, np.where(group == 0, group[0], group))  # the start keeps number 0
        _, one = np.unique(group, return_index=True)
        self.step = group[step[one]].astype(np.uint16)
        self.accepts = [self.accept[i] for i in one]
        self.dead = next((s for s in range(len(one)) if not self.accepts[s] and (self.step[s] == s).all()), -1)
        del self.next, self.accept, self.edges


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([r.pattern for r in rules], True)
        self.ahead = [Automaton([r.whole or r.pattern], False) for r in rules]
        self.back = [Automaton([r.pattern], False, True) for r in rules]
        self.hit = np.array([bool(a) for a in self.all.accepts])

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of bytes at which some rule's match ends, and the states there. Blocks of BLOCK bytes, each from the last one's end state."""
        places, states, entry = [], [], 0
        for at in range(0, len(data), BLOCK):
            found, own, entry = self._block(data[at : at + BLOCK], entry)
            places.append(found + at)
            states.append(own)
        return (np.concatenate(places), np.concatenate(states)) if places else (np.empty(0, np.int64), np.empty(0, np.uint16))

    def _block(self, data: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray, int]:
        a, n = self.all, len(data)
        lanes = min(LANES, max(1, n // 64))
        length = -(-n // lanes)
        padded = np.full(lanes * length, a.of[SEPARATOR], np.uint8)
        padded[:n] = a.of[data]
        columns = np.ascontiguousarray(padded.reshape(lanes, length).T)
        width, flat = a.step.shape[1], a.step.reshape(-1)
        states = np.empty((length, lanes), np.uint16)
        entered = np.zeros(lanes, np.uint16)
        entered[0] = entry
        now = entered.astype(np.intp)
        for t in range(length):
            now = flat[now * width + columns[t]].astype(np.intp)
            states[t] = now
        redo = np.arange(1, lanes)
        while len(redo := redo[states[-1, redo - 1] != entered[redo]]):
            entered[redo] = states[-1, redo - 1]
            now, own, changed = entered[redo].astype(np.intp), redo, []
            for t in range(length):
                now = flat[now * width + columns[t, own]].astype(np.intp)
                other = states[t, own] != now
                own, now = own[other], now[other]
                if not len(own):
                    break
                states[t, own] = now
            else:
                changed = own  # their last state is another one now: the lanes after them look again
            redo = np.array([x + 1 for x in changed if x + 1 < lanes], np.int64)
        ends = states.T.reshape(-1)[:n]
        found = np.flatnonzero(self.hit[ends])
        return found, ends[found], int(ends[-1])

    def spans(self, data: bytes, ends: list[int], states: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes of one text, from the places at which matches end in it."""
        out = []
        for r, rule in enumerate(self.rules):
            ahead, back, done = self.ahead[r], self.back[r], 0
            for e, s in zip(ends, states, strict=True):
                if r not in self.all.accepts[s] or e < done:
                    continue
                state, start, at = 0, None, e
                while at >= done and (state := int(back.step[state, back.of[data[at]]])) != back.dead:
                    if back.accepts[state]:
                        start = at
                    at -= 1
                if start is None or rule.alone and start and data[start - 1] in ALNUM:
                    continue
                state, at, done = 0, start, start
                while at < len(data) and (state := int(ahead.step[state, ahead.of[data[at]]])) != ahead.dead:
                    at += 1
                    if ahead.accepts[state]:
                        done = at
                if done - start - (re.match(rule.prefix.encode(), data[start:done]).end() if rule.prefix else 0) >= rule.least:
                    out.append((start, done, r))
        return sorted(out, key=lambda x: (x[0], x[2]))

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) in code points, for each text."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(bytes([SEPARATOR]).join([*raw, b""]), np.uint8)
        found, states = self.hits(data)
        begins = np.cumsum([0, *(len(b) + 1 for b in raw)])
        cuts = np.searchsorted(found, begins)
        out = []
        for i, b in enumerate(raw):
            x, y = cuts[i], cuts[i + 1]
            spans = self.spans(b, (found[x:y] - begins[i]).tolist(), states[x:y].tolist()) if y > x else []
            if spans and len(b) != len(texts[i]):
                point = np.cumsum((np.frombuffer(b, np.uint8) & 0xC0) != 0x80) - 1
                spans = [(int(point[s]), int(point[e - 1]) + 1, r) for s, e, r in spans]
            out.append([(s, e, self.rules[r].kind) for s, e, r in spans])
        return out


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


BASE = ("assign", "access", "hex")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row."""
    own = shared(docs.sparkSession, Scanner(rules))

    def make():
        scanner = own()

        def work(texts):
            found = scanner.scan(texts)
            base = [[s for s in spans if s[2] in BASE] for spans in found]
            return {f"n_{k}": [sum(s[2] == k for s in spans) for spans in base] for k in BASE} | {"base_sha256": [hashlib.sha256(digest(b).encode()).hexdigest() for b in base], "spans": list(map(digest, found))}

        return work

    run = by_text(docs.sparkSession, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("r")).select("doc_id", "r.*")


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> Column:
    """The text with each secret replaced by mark; overlapping spans become one mark. Null stays null."""
    own = shared(docs.sparkSession, Scanner(rules))

    def cut(text, spans):
        if not spans:
            return text
        out, at = [], 0
        for s, e, _ in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def make():
        return lambda texts: {"text": [cut(t, spans) for t, spans in zip(texts, own().scan(texts), strict=True)]}

    return by_text(docs.sparkSession, make, "text string")(F.col(text_col))["text"]
