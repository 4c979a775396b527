"""Personal data and secrets by a skip-chain conditional random field (after Sutton and McCallum, 2004).

Tokens are the runs between white space.  Successive tokens share a potential.  All tokens of one document that are the same
or similar, which means the same letters and digits in the same order, share one factor, however many and far apart they
are: each is linked to that other one of them that speaks most for an entity.  Recurrences without a name are the same
evidence again, so they don't outvote it.  Loopy message passing until the messages stand still makes labels agree over
the whole document.  So a secret that is named once is found wherever it recurs.

Every token of every document is a node of the field.  Messages are passed among those that may be entities: the tokens with a digit or '@', those
that follow a secret's name and '=' or ':', and those that are the same as any of these.  All others are labelled O by every feature that they
can have, and take part as observed neighbours.

The weights are trained piecewise (Sutton and McCallum, 2005) on documents labelled by distant supervision: strict patterns with
checks give the labels, which the same tokens of a document share.  The unary weights come from features that generalise beyond the patterns, and the
potentials of chain and links from how often labels meet there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import hash60, map_arrow, table
from corpusmill.llm.tokens import as_strings, buffers, pieces

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET")
#: Documents that the weights are learned from: about so many of those with any candidate, those whose id hashes are lowest.
TRAIN_DOCS = 3000
#: A document's messages are passed until none changes by more than STILL; a field that swings without end is left after ROUNDS.
ROUNDS, DAMP, STILL = 1000, 0.3, 1e-6
#: Links counted beforehand, of equal and of different labels.
AGREE = (1.0, 0.02)
SCHEMA = "n_entities int, entities array<struct<label:string,start:int,end:int>>, redacted string"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True
_EDGE = re.compile(r"^[^0-9A-Za-z@+(]+|[^0-9A-Za-z@)]+$")
_ALNUM = re.compile(r"[^0-9a-z]+")

_EMAIL = re.compile(r"[%+.0-9A-Z_a-z-]+@[0-9A-Za-z-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.ASCII)
_IP = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}", re.ASCII)
_CARD = re.compile(r"(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13})", re.ASCII)
_HEX = re.compile(r"[0-9A-Za-z_\-]{16,}", re.ASCII)
_KEY = re.compile(r"A(?:KI|SI|ID|RO)A[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|glpat-[\w-]{20,}|sk-[\w-]{32,}|xox[baprs]-[\w-]{10,}|AIza[\w-]{35}", re.ASCII)
_ASSIGN = re.compile(r"([A-Za-z_-]+[\"']?)([=:])[\"']?([^\s\"']{8,})", re.ASCII)
_NAMES = re.compile(r"(?:api[_-]?key|token|secret|password|passwd|pwd)[\"']?$", re.I)
_NAMING = re.compile(rb"(?:api[_-]?key|token|secret|password|passwd|pwd)[\"']?$", re.I)
#: Java regex that a text with any candidate matches.
MAY_HOLD = "[0-9@]|(?i:api[_-]?key|token|secret|passw|pwd)"


@dataclass(slots=True)
class Token:
    """A token that may be part of an entity: its place in the text, its core without outer punctuation, and its neighbours."""

    index: int
    start: int
    core: str
    before: str
    before2: str
    after: str


def candidates(text: str) -> list[Token]:
    """The tokens that may be entities, with their numbers among all tokens."""
    return [t for _, ts in _candidates(pa.array([text], pa.large_string())) for t in ts]


def _candidates(strings: pa.Array) -> Iterator[tuple[int, list[Token]]]:
    """(row, candidates) for the rows that have any; all bytes are searched in numpy, only the tokens found become objects."""
    raw, offsets = buffers(strings)
    if not len(raw):
        return
    marks = np.flatnonzero(_MARK[raw])
    # where the '=' or ':' after a name stands
    signs = np.flatnonzero((raw == 61) | (raw == 58))
    named = np.array([p for p, start in zip(signs.tolist(), offsets[np.searchsorted(offsets, signs, side="right") - 1].tolist(), strict=True) if _NAMING.search(_left(raw, start, p))], np.int64)
    mark_row, named_row = np.searchsorted(offsets, marks, side="right") - 1, np.searchsorted(offsets, named, side="right") - 1
    marks_at, named_at = np.searchsorted(mark_row, np.arange(len(offsets))), np.searchsorted(named_row, np.arange(len(offsets)))
    for row in np.union1d(mark_row, named_row):
        a, b = int(offsets[row]), int(offsets[row + 1])
        space = np.concatenate([[True], _SPACE[raw[a:b]], [True]])
        step = np.diff(space.astype(np.int8))
        starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        own = np.unique(np.searchsorted(starts, marks[marks_at[row] : marks_at[row + 1]] - a, side="right") - 1)
        data = raw[a:b].tobytes()

        def token(i: int, starts: np.ndarray = starts, ends: np.ndarray = ends, data: bytes = data) -> str:
            return data[starts[i] : ends[i]].decode("utf-8", "replace") if 0 <= i < len(starts) else ""

        if named_at[row + 1] > named_at[row]:
            # the token that the byte after the name lies in, or the one after it
            after = np.minimum(np.searchsorted(ends, named[named_at[row] : named_at[row + 1]] - a + 1, side="right"), len(starts) - 1)
            more = np.setdiff1d(after, own)
            if len(more):
                keys = {k for i in more if (k := _same(_token(int(i), token, 0)))}
                every = [i for i in range(len(starts)) if _ALNUM.sub("", token(i).lower()) in keys] if keys else []
                own = np.union1d(own, np.union1d(more, np.array(every, np.int64)))
        # characters before each byte
        chars = np.cumsum((raw[a:b] & 0xC0) != 0x80)
        yield int(row), [_token(int(i), token, int(chars[starts[i]] - 1)) for i in own]


def _left(raw: np.ndarray, start: int, end: int) -> bytes:
    """The bytes before a place that a name may have, without the blanks between."""
    reach = 32
    while not (left := raw[max(start, end - reach) : end].tobytes().rstrip(b" \t")) and end - reach > start:
        reach *= 4
    left = raw[max(start, end - reach - 16) : end].tobytes().rstrip(b" \t")
    return left[-16:]


def _token(i: int, token: Callable[[int], str], start: int) -> Token:
    """The i-th token of a text that starts at this character; a name with '=' or ':' before the value, in the token or as the one before, counts as two tokens before it."""
    whole = token(i)
    core = _EDGE.sub("", whole)
    lead = whole.find(core) if core else 0
    before, before2 = token(i - 1), token(i - 2)
    if (m := _ASSIGN.match(core)) and _NAMES.search(m[1]):
        lead, core, before, before2 = lead + m.start(3), m[3], m[2], m[1]
    elif before[-1:] in ("=", ":") and _NAMES.search(before[:-1]):
        before, before2 = before[-1], before[:-1]
    return Token(i, start + lead, core, before, before2, token(i + 1))


def luhn(digits: str) -> bool:
    """Whether the last digit of a card number checks."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def strict_labels(tokens: list[Token]) -> list[int]:
    """Labels by strict patterns: what the weights are learned from.

    Cards need an issuer's prefix and length and a valid check digit.  Phones are '+1 (ddd) ddd-dddd' and near forms; secrets
    have a vendor's prefix or follow a name such as token or password and a '=' or ':'.
    """
    labels = []
    cores = {t.index: t.core for t in tokens}
    for t in tokens:
        c = t.core
        if _EMAIL.fullmatch(c):
            labels.append(1)
        elif re.fullmatch(r"\+\d{1,3}", c) and re.fullmatch(r"\(?\d{2,4}\)?", cores.get(t.index + 1, "")) or re.fullmatch(r"\(\d{2,4}\)", c) and re.fullmatch(r"\d{3,4}-\d{3,4}", cores.get(t.index + 1, "")) or re.fullmatch(r"\d{3,4}-\d{3,4}", c) and re.fullmatch(r"\(\d{2,4}\)", cores.get(t.index - 1, "")):
            labels.append(2)
        elif _IP.fullmatch(c) and all(int(x) < 256 for x in c.split(".")):
            labels.append(3)
        elif _CARD.fullmatch(c) and luhn(c):
            labels.append(4)
        elif _KEY.fullmatch(c):
            labels.append(5)
        elif (_HEX.fullmatch(c) and re.search(r"\d", c) and re.search(r"[A-Za-z]", c) or len(c) >= 8 and not _plain(c)) and t.before in ("=", ":") and _NAMES.search(t.before2):
            labels.append(5)
        else:
            labels.append(0)
    return labels


def _plain(c: str) -> bool:
    """Whether a core is words, numbers or an assignment's code: nothing that looks made up."""
    return all(not p or p.isdigit() or p.isalpha() and (p[1:].islower() or p.isupper() or len(p) == 1) for p in re.split(r"[-_.,'/()]", c))


def shared_labels(tokens: list[Token]) -> list[int]:
    """``strict_labels``, which the same tokens share: those labelled O have the most frequent other label of their group."""
    labels = strict_labels(tokens)
    for g in groups(tokens):
        if found := Counter(labels[i] for i in g if labels[i]):
            most = min(found, key=lambda k: (-found[k], k))
            for i in g:
                labels[i] = labels[i] or most
    return labels


def shape(core: str) -> str:
    """Runs of digits as d and their length to 4, letters as a, other characters as they are."""
    s = re.sub(r"[^\W\d_]+", "a", core)
    return re.sub(r"\d+", lambda m: f"d{len(m[0])}" if len(m[0]) < 5 else f"d{5 * (len(m[0]) // 5)}+", s)


def observations(t: Token) -> list[str]:
    """The names of a token's features."""
    c = t.core
    digits = sum(x.isdigit() for x in c)
    found = [f"shape={shape(c)}", f"len={min(len(c), 60) // 4}", f"digits={min(digits, 20)}", f"share={int(4 * digits / max(1, len(c)))}"]
    if "@" in c:
        found.append("at.dot" if "." in c.rpartition("@")[2] else "at")
    if c.isdigit():
        found += [f"number={c[0]}:{len(c)}", f"check={len(c) // 4}:{luhn(c)}"]
    if c.count(".") == 3 and c.replace(".", "").isdigit():
        found.append("quad.ok" if all(x and int(x) < 256 for x in c.split(".")) else "quad.bad")
    if len(c) >= 16 and re.fullmatch(r"[0-9a-f]+", c) and not c.isdigit():
        found.append("hex")
    if len(c) >= 16 and digits and digits < len(c) and _HEX.fullmatch(c):
        found += ["mixed", f"prefix={c[:4]}" if c[:4].isalpha() else "prefix"]
    if _KEY.fullmatch(c):
        found.append("vendor")
    found.append(f"before={_word(t.before)}")
    found.append(f"before2={_word(t.before2)}")
    if t.before in ("=", ":") and _NAMES.search(t.before2):
        found.append("named")
    found.append(f"after={_word(t.after)}")
    return found


def _word(w: str) -> str:
    if w in ("=", ":", ""):
        return w
    return _NAMES.search(w)[0].lower() if _NAMES.search(w) else shape(w) if re.search(r"\d", w) else "word"


@dataclass
class Field:
    """The weights: a row of label weights for each feature, and log potentials of successive labels and of linked ones."""

    unary: dict[str, np.ndarray]
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, tokens: list[Token]) -> np.ndarray:
        out = np.tile(self.bias, (len(tokens), 1))
        for i, t in enumerate(tokens):
            for f in observations(t):
                if (w := self.unary.get(f)) is not None:
                    out[i] += w
        return out


def _successive(tokens: list[Token]) -> list[tuple[int, int]]:
    return [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1].index == tokens[i].index + 1]


def _same(t: Token) -> str | None:
    """What tokens that are linked have in common: their letters and digits, at least six."""
    k = _ALNUM.sub("", t.core.lower())
    return k if len(k) >= 6 else None


def links(tokens: list[Token]) -> tuple[np.ndarray, np.ndarray]:
    """(chain, skip) edges: between successive tokens, and from each token to the last one before it with the same letters and digits, of at least six.

    The skip edges are what potentials are counted over; labels are found with ``groups``.
    """
    chain = _successive(tokens)
    last: dict[str, int] = {}
    skip = []
    for i, t in enumerate(tokens):
        if (k := _same(t)) is not None:
            # a chain edge to the token before
            if k in last and not (last[k] == i - 1 and t.index == tokens[i - 1].index + 1):
                skip.append((last[k], i))
            last[k] = i
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


def groups(tokens: list[Token]) -> list[list[int]]:
    """The tokens with the same letters and digits, of at least six, where there are several."""
    found: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        if (k := _same(t)) is not None:
            found.setdefault(k, []).append(i)
    return [g for g in found.values() if len(g) > 1]


def marginals(
    unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS, damp: float = DAMP,
    same: list[np.ndarray] | None = None, skip: np.ndarray | None = None, doc: np.ndarray | None = None,
) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product message passing; exact where there is no loop and no group of over two.

    ``edges`` (a, b), ``potentials`` the log potentials of each edge, by label of a and label of b.  ``same`` has groups of at
    least two nodes, no node in two of them; each node's message from its group is the one that the node of the others with the best odds against
    label 0 sends by ``skip``, which is symmetric.  All messages of a round are made at once from those of the round before.  Each document of
    ``doc``, by default all nodes, ends when its messages stand still, so that no document's labels depend on another.
    """
    n, labels = unary.shape
    same = same or []
    if not len(edges) and not same:
        return _softmax(unary)
    doc = np.zeros(n, np.int64) if doc is None else doc
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pot = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    member = np.concatenate(same) if same else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(same)), [len(g) for g in same])
    m, s = np.zeros((len(source), labels)), np.zeros((len(member), labels))
    live = np.ones(int(doc.max()) + 1, bool)
    total = unary.copy()
    e, o, nodes = np.arange(len(source)), np.arange(len(member)), np.arange(n)

    def send(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        return new - new.max(axis=1, keepdims=True)

    for _ in range(max(rounds, 1)):
        moved = np.zeros(len(live))
        m_new = damp * m[e] + (1 - damp) * send((total[source[e]] - m[back[e]])[:, :, None] + pot[e])
        np.maximum.at(moved, doc[target[e]], np.abs(m_new - m[e]).max(axis=1))
        if len(o):
            own = total[member[o]] - s[o]
            odds = np.logaddexp.reduce(own[:, 1:], axis=1) - own[:, 0]
            order = np.lexsort((-odds, group[o]))
            first = np.flatnonzero(np.diff(group[o], prepend=-1))
            at = np.cumsum(np.diff(group[o], prepend=-1) > 0) - 1
            best, second = order[first], order[first + 1]
            by = np.where(best[at] == np.arange(len(o)), second[at], best[at])
            s_new = damp * s[o] + (1 - damp) * send(own[by][:, :, None] + skip)
            np.maximum.at(moved, doc[member[o]], np.abs(s_new - s[o]).max(axis=1))
            s[o] = s_new
        m[e] = m_new
        total[nodes] = unary[nodes]
        np.add.at(total, target[e], m[e])
        total[member[o]] += s[o]
        now = live & (moved > STILL)
        if not now.any():
            break
        if not np.array_equal(now, live):
            live = now
            e, o, nodes = e[live[doc[target[e]]]], o[live[doc[member[o]]]], nodes[live[doc[nodes]]]
    return _softmax(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str]) -> Field:
    """The weights from documents labelled by ``shared_labels``.

    Unary weights: multinomial logistic regression over the features seen at least twice.  Chain and skip
    potentials: the log ratios of how often labels meet to how often they would by chance, smoothed; what is
    counted for links beforehand (AGREE) says that linked tokens agree, so that a label which no training document repeats is linked as well.  Without any token that
    could be an entity all weights are 0 but those that make O the label.
    """
    k = len(LABELS)
    docs = [ts for text in texts if (ts := candidates(text))]
    names = Counter(f for ts in docs for t in ts for f in set(observations(t)))
    index = {f: i for i, f in enumerate(sorted(f for f, c in names.items() if c > 1))}
    rows, cols, y = [], [], []
    chain, skip = np.full((k, k), 0.5), np.where(np.eye(k, dtype=bool), *AGREE)
    for ts in docs:
        labels = shared_labels(ts)
        for t, label in zip(ts, labels, strict=True):
            for f in observations(t):
                if f in index:
                    rows.append(len(y))
                    cols.append(index[f])
            y.append(label)
        for i, t in enumerate(ts):
            # neighbours that are known to be O
            if t.before and (i == 0 or ts[i - 1].index != t.index - 1):
                chain[0, labels[i]] += 1
            if t.after and (i + 1 == len(ts) or ts[i + 1].index != t.index + 1):
                chain[labels[i], 0] += 1
        c, s = links(ts)
        for a, b in c:
            chain[labels[a], labels[b]] += 1
        for a, b in s:
            # both directions: distant tokens have no order
            skip[labels[a], labels[b]] += 1
            skip[labels[b], labels[a]] += 1
    bias = np.zeros(k)
    if not y:
        bias[0] = 5.0
        return Field({}, bias, np.zeros((k, k)), np.zeros((k, k)))
    r, c, t = np.array(rows), np.array(cols), np.array(y)
    w, bias = _multinomial(r, c, t, len(index), k)
    met = lambda m: np.clip(np.log(m / m.sum()) - np.log(m.sum(axis=1)[:, None] / m.sum() * m.sum(axis=0)[None, :] / m.sum()), -3, 3)
    return Field({f: w[i] for f, i in index.items()}, bias, met(chain), met(skip))


def _multinomial(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, d: int, k: int, l2: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the regularised regression over binary features, by accelerated gradient steps."""
    n = len(y)
    most = int(np.bincount(rows, minlength=n).max()) if len(rows) else 1
    step = 1.0 / (0.25 * (most + 1) + l2)
    w = u = np.zeros((d, k))
    b = c = np.log((np.bincount(y, minlength=k) + 0.5) / (n + 0.5 * k))
    hot = np.zeros((n, k))
    hot[np.arange(n), y] = 1
    order = np.argsort(cols, kind="stable")
    by_col, starts = rows[order], np.searchsorted(cols[order], np.arange(d))
    some = np.diff(np.append(starts, len(cols))) > 0
    share = np.maximum(np.diff(np.append(starts, len(cols))), 1)[:, None] / n
    for i in range(rounds):
        z = np.tile(c, (n, 1))
        np.add.at(z, rows, u[cols])
        g = (_softmax(z) - hot) / n
        gw = np.zeros((d, k))
        if len(by_col):
            gw[some] = np.add.reduceat(g[by_col], starts[some], axis=0)
        # features are rare by different degrees: each has a step of its own
        w_ = u - step * (gw / share + l2 * u)
        b_ = c - step * g.sum(axis=0)
        m = i / (i + 3.0)
        u, c, w, b = w_ + m * (w_ - w), b_ + m * (b_ - b), w_, b_
    return w, b


def label_batch(field: Field, docs: list[list[Token]]) -> list[np.ndarray]:
    """The most probable label of each token of each document; one message passing for all."""
    tokens = [t for ts in docs for t in ts]
    unary = field.scores(tokens)
    edges, same = [], []
    base = 0
    for ts in docs:
        edges.append(np.array(_successive(ts), np.int64).reshape(-1, 2) + base)
        same += [np.array(g) + base for g in groups(ts)]
        # neighbours that are known to be O
        for i, t in enumerate(ts):
            if t.before and (i == 0 or ts[i - 1].index != t.index - 1):
                unary[base + i] += field.chain[0]
            if t.after and (i + 1 == len(ts) or ts[i + 1].index != t.index + 1):
                unary[base + i] += field.chain[:, 0]
        base += len(ts)
    if not tokens:
        return [np.zeros(0, np.int64) for _ in docs]
    chain = np.concatenate(edges)
    doc = np.repeat(np.arange(len(docs)), [len(ts) for ts in docs])
    p = marginals(unary, chain, np.broadcast_to(field.chain, (len(chain), *field.chain.shape)), same=same, skip=field.skip, doc=doc)
    best = p.argmax(axis=1)
    ends = np.cumsum([len(ts) for ts in docs])
    return np.split(best, ends[:-1])


def entities(tokens: list[Token], labels: np.ndarray) -> list[tuple[str, int, int]]:
    """(label, start, end) in characters; successive tokens of one telephone number are one entity."""
    out: list[tuple[str, int, int]] = []
    before = None
    for t, k in zip(tokens, labels, strict=True):
        if k and t.core:
            end = t.start + len(t.core)
            plus = t.core[:1] == "+"
            if LABELS[k] == "PHONE" and before == (t.index - 1, k) and not plus:
                out[-1] = (out[-1][0], out[-1][1], end)
            else:
                out.append((LABELS[k], t.start, end))
            before = (t.index, k)
        else:
            before = None
    return out


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each entity replaced by its label in brackets."""
    parts, at = [], 0
    for label, a, b in found:
        parts += [text[at:a], f"[{label}]"]
        at = b
    return "".join([*parts, text[at:]])


def find_private(docs: DataFrame, train_docs: int = TRAIN_DOCS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_entities, entities, redacted) for each row of ``docs`` in which an entity is found; ``entities`` has (label, start, end) in characters.

    Null and empty texts have no entities.  Repeated rows give repeated rows.  Whole texts are searched, however long.  Of labels with
    equal probabilities the first of LABELS is taken.  The weights come from about ``train_docs`` documents that may hold an entity, chosen by id hash;
    with none, nothing is found.  An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    marked = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(MAY_HOLD))
    n = marked.count()
    cut = int(min(1.0, train_docs / max(n, 1)) * (1 << 60))
    sample = marked.where(hash60("doc_id") < cut).select("text").toArrow()["text"].to_pylist()
    field = docs.sparkSession.sparkContext.broadcast(train(sorted(sample)))
    kind = docs.schema[id].dataType.simpleString()
    struct = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = as_strings(batch.column(1))
            for a, b in pieces(strings):
                part = strings.slice(a, b - a)
                found = list(_candidates(part))
                rows, spans, texts = [], [], []
                for (row, ts), labels in zip(found, label_batch(field.value, [ts for _, ts in found]), strict=True):
                    if es := entities(ts, labels):
                        rows.append(a + row)
                        spans.append(es)
                        texts.append(redact(part[row].as_py(), es))
                if rows:
                    es = pa.array([[{"label": x, "start": y, "end": z} for x, y, z in s] for s in spans], struct)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([len(s) for s in spans], pa.int32()), es, pa.array(texts, pa.string())], ["doc_id", "n_entities", "entities", "redacted"])

    return map_arrow(marked, run, f"doc_id {kind}, {SCHEMA}")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data or secrets: what was found where, and the redacted text."""
    return find_private(table(spark, sf_dir, "documents"))
