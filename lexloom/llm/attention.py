"""A small causal self-attention language model, trained and run in numpy.

Tokens are read in rows of STEP; a row's tokens attend to themselves and to what came before, back
through the previous row, so overlapping windows of 2 * STEP score every token once. The output is
a softmax over classes of tokens and one over the members of the class; a last pair of classes
holds the rest, whose tokens keep their smoothed shares, so the probabilities of all ids add up to
one. What follows each single token is counted over the whole corpus and enters both softmaxes as
fixed logits; attention learns the rest.
"""

from __future__ import annotations

import numpy as np

from lexloom.llm.sums import sorted_sum

#: Tokens of a row, width, tokens with an embedding of their own.
STEP, WIDTH, INPUTS = 16, 16, 1023
#: Outputs: classes, and the tokens in each that have an output of their own.
CLASSES, MEMBERS = 64, 32
OWN = CLASSES * MEMBERS
#: Rows of an update, on large and on small corpora; step size.
MOST_ROWS, ROWS, RATE = 512, 64, 0.01
BAN = np.float32(-1e9)
#: Rows that are learned from at once, so that what they need stays in the cache.
BLOCK = 64
#: keys minus query: distances 0..STEP*2-1; a query at place q of its row sees keys 0..STEP+q.
DISTANCE = np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)[None, :]
FUTURE = DISTANCE < 0


class Vocabulary:
    """Which ids have an input and an output of their own, and the shares of the others.

    opens says which ids open a word or end a text. A class holds ids that do or ids that don't,
    MEMBERS neighbours by frequency; the last two classes are the rest of either kind.
    slots: of each id its class * MEMBERS + its place there, or OWN and OWN + 1 in the rest.
    """

    def __init__(self, counts: np.ndarray, opens: np.ndarray | None = None):
        opens = np.zeros(len(counts), bool) if opens is None else opens.astype(bool)
        order = np.lexsort([np.arange(len(counts)), -counts])
        self.inputs = np.full(len(counts), INPUTS, np.int16)
        self.inputs[order[:INPUTS]] = np.arange(min(INPUTS, len(counts)))
        top = order[: OWN - MEMBERS]
        first, second = top[opens[top]], top[~opens[top]]
        begin = -(-len(first) // MEMBERS)  # classes of ids that open a word
        self.slots = np.where(opens, OWN, OWN + 1).astype(np.int16)
        self.slots[first] = np.arange(len(first))
        self.slots[second] = begin * MEMBERS + np.arange(len(second))
        self.classes = class_of(self.slots).astype(np.int16)
        self.opening = np.zeros(CLASSES + 2, bool)
        self.opening[:begin] = self.opening[CLASSES] = True
        self.inside = np.zeros(len(counts), np.float32)
        for kind in (OWN, OWN + 1):
            rest = np.flatnonzero(self.slots == kind)
            if len(rest):
                self.inside[rest] = np.log((counts[rest] + 1.0) / (counts[rest] + 1.0).sum())


def class_of(slots: np.ndarray) -> np.ndarray:
    return np.where(slots < OWN, slots // MEMBERS, slots - OWN + CLASSES)


def pair_counts(ids: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """How often each slot follows each input (the last of which stands for a text's beginning)."""
    before = np.full(len(ids), INPUTS + 1, np.int64)
    before[1:] = vocabulary.inputs[ids[:-1]]
    before[first[:-1][np.diff(first) > 0]] = INPUTS + 1
    width = OWN + 2
    return np.bincount(before * width + vocabulary.slots[ids], minlength=(INPUTS + 2) * width).reshape(-1, width).astype(np.float64)


def pair_logits(counts: np.ndarray, prior: float = 6.0) -> dict[str, np.ndarray]:
    """Smoothed log shares after each input: of each class, and of each member inside its class."""
    members = counts[:, :OWN].reshape(-1, CLASSES, MEMBERS)
    classes = np.concatenate([members.sum(2), counts[:, OWN:]], 1)
    share = np.maximum((classes.sum(0) + 0.1) / (classes.sum() + 0.1 * classes.shape[1]), 1e-12)
    inside = members.sum(0) + 1e-6
    inside /= inside.sum(1, keepdims=True)
    out = {"pair": np.log((classes + prior * share) / (classes.sum(1, keepdims=True) + prior))}
    out["inside"] = np.log((members + prior * inside) / (members.sum(2, keepdims=True) + prior))
    return {k: v.astype(np.float32) for k, v in out.items()}


#: What is learned; the pairs' logits are counted.
SHAPES = {"embed": (INPUTS + 2, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "out": (WIDTH, WIDTH), "near": (2 * STEP,), "logit": (WIDTH, CLASSES + 2), "member": (CLASSES, WIDTH, MEMBERS)}


def new_parameters(pairs: dict[str, np.ndarray] | None = None, seed: int = 1) -> dict[str, np.ndarray]:
    """Random parameters; the outputs' begin small, so that the model begins as the counted pairs."""
    draw = np.random.default_rng(seed)
    scale = {"near": 0.0, "logit": 0.02, "member": 0.02}
    p = {k: (draw.standard_normal(s) * scale.get(k, 0.25)).astype(np.float32) for k, s in SHAPES.items()}
    none = {"pair": np.zeros((INPUTS + 2, CLASSES + 2), np.float32), "inside": np.zeros((INPUTS + 2, CLASSES, MEMBERS), np.float32)}
    return p | (pairs or none)


def packed(p: dict) -> np.ndarray:
    """The learned parameters as one vector."""
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float64)


def unpacked(vector: np.ndarray, pairs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = dict(pairs), 0
    for k, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[k] = vector[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(-1, keepdims=True))
    return powers / powers.sum(-1, keepdims=True)


def tables_of(p: dict) -> tuple[np.ndarray, ...]:
    """(query, key, value, value as the hidden state shows it) of each input; the queries are scaled."""
    value = p["embed"] @ p["value"]
    return (p["embed"] @ p["query"]) * np.float32(WIDTH**-0.5), p["embed"] @ p["key"], value, value @ p["out"]


def as_pairs(rows: np.ndarray) -> np.ndarray:
    """(rows - 1, 2 * STEP, WIDTH): each row of STEP places behind the one before it, without a copy."""
    step = rows.strides[0]
    return np.lib.stride_tricks.as_strided(rows, (len(rows) // STEP - 1, 2 * STEP, WIDTH), (STEP * step, step, rows.strides[1]), writeable=False)


def near_of(p: dict) -> np.ndarray:
    """What is added to the scores of a row's places (lines) and the places they see (columns)."""
    return np.where(FUTURE, BAN, p["near"][np.maximum(DISTANCE, 0)]).astype(p["near"].dtype)


def powers(logits: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials of the logits and what is added to them, in place, and their sums along the last axis); the largest of what is added to a line is moderate."""
    large = logits.size and max(logits.max(), -logits.min()) > 60  # they could overflow or vanish
    logits += added
    if large:
        logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[-1], logits.dtype)


def summed_by(index: np.ndarray, arrays: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Rows of each array summed by an index below n. Groups are filled up to pieces of eight rows, which add up in long runs, by a last row of zeros that each array has beyond the index."""
    index = index.astype(np.int16)
    order = np.argsort(index, kind="stable")
    size = np.bincount(index, minlength=n)
    pieces = -(-size // 8)
    lead, edge = np.cumsum(pieces) * 8, np.cumsum(size)
    grid = np.full(int(pieces.sum()) * 8, len(index))
    grid[np.arange(len(index)) + np.repeat((lead - pieces * 8) - (edge - size), size)] = order
    of, out = np.repeat(np.arange(n), pieces), []
    for values in arrays:
        width = values.shape[1]
        some = values.take(grid, 0).reshape(-1, 8 * width)
        for half in (4, 2, 1):
            some = some[:, : half * width] + some[:, half * width :]
        out.append(sorted_sum(of, some, n))
    return out


def loss_and_gradient(p: dict, inputs: np.ndarray, known: np.ndarray, target: np.ndarray, counted: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of the counted target slots, and its gradient by the learned parameters.

    As there are far fewer inputs than places, queries, keys and values are worked out once an
    input, and their gradients are summed by input before they go back through the matrices.
    """
    query_of, key_of, value_of, shown_of = tables_of(p)
    before, slot, counted = inputs[:, STEP:].ravel(), target.ravel(), counted.ravel()
    kind, like, n_inputs = class_of(slot), p["embed"], len(p["embed"])
    near = near_of(p)
    state, d_state, d_query = (np.empty((len(before) + 1, WIDTH), like.dtype) for _ in range(3))
    d_key, d_shown = (np.empty((inputs.size + 1, WIDTH), like.dtype) for _ in range(2))
    for x in (d_state, d_query, d_key, d_shown):
        x[-1] = 0  # what groups are filled up with
    parts = [(slice(a, b), slice(a * STEP, b * STEP), slice(a * 2 * STEP, b * 2 * STEP)) for a in range(0, len(inputs), BLOCK) for b in (min(a + BLOCK, len(inputs)),)]
    kept, loss, g, one = [], 0.0, {"logit": np.zeros_like(p["logit"])}, np.float32(1 / max(1, counted.sum()))
    shares, back, line = counted * one, np.ascontiguousarray(p["logit"].T), np.arange(BLOCK * STEP)
    for rows, some, _ in parts:
        query = query_of.take(before[some], 0).reshape(-1, STEP, WIDTH)
        key, shown = key_of.take(inputs[rows], 0), shown_of.take(inputs[rows], 0)
        scores, bias = query @ key.transpose(0, 2, 1), near
        if not known[rows].all():
            bias = np.where(known[rows][:, None, :], near, BAN)
        weights, sums = powers(scores, bias)
        weights *= (1 / sums)[..., None]
        mixed = weights @ shown
        np.add(like.take(before[some], 0), mixed.reshape(-1, WIDTH), out=state[some])
        kept.append((query, key, shown, weights, mixed))
        d_class, sums = powers(state[some] @ p["logit"], p["pair"].take(before[some], 0))
        here = line[: len(sums)]
        loss -= np.log(d_class[here, kind[some]] / sums + 1e-30) @ shares[some]
        d_class *= (shares[some] / sums)[:, None]
        d_class[here, kind[some]] -= shares[some]
        g["logit"] += state[some].T @ d_class
        np.matmul(d_class, back, out=d_state[some])
    own = np.flatnonzero(counted & (slot < OWN))
    own = own[np.argsort(kind[own].astype(np.int16), kind="stable")]
    kind, place, line, mine = kind[own], slot[own] % MEMBERS, np.arange(len(own)), state.take(own, 0)
    edge = np.searchsorted(kind, np.arange(CLASSES + 1))
    runs = [(k, slice(edge[k], edge[k + 1])) for k in np.flatnonzero(np.diff(edge)).tolist()]
    d_member = np.empty((len(own), MEMBERS), like.dtype)
    for k, some in runs:
        np.matmul(mine[some], p["member"][k], out=d_member[some])
    d_member, sums = powers(d_member, p["inside"].reshape(-1, MEMBERS).take(before[own] * CLASSES + kind, 0))
    loss -= np.log(d_member[line, place] / sums + 1e-30).sum() * one
    d_member *= (one / sums)[:, None]
    d_member[line, place] -= one
    g["member"], d_own = np.zeros_like(p["member"]), np.empty_like(mine)
    for k, some in runs:
        np.matmul(mine[some].T, d_member[some], out=g["member"][k])
        np.matmul(d_member[some], p["member"][k].T, out=d_own[some])
    d_state[own] += d_own
    d_near = np.zeros(STEP * 2 * STEP, like.dtype)
    for (_, some, keys), (query, key, shown, weights, mixed) in zip(parts, kept):
        d_mixed = d_state[some].reshape(mixed.shape)
        d_scores = d_mixed @ shown.transpose(0, 2, 1)
        d_scores -= np.einsum("rsw,rsw->rs", d_mixed, mixed)[..., None]
        d_scores *= weights
        d_near += np.ones(len(mixed), like.dtype) @ d_scores.reshape(len(mixed), -1)
        np.matmul(d_scores, key, out=d_query[some].reshape(mixed.shape))
        np.matmul(d_scores.transpose(0, 2, 1), query, out=d_key[keys].reshape(key.shape))
        np.matmul(weights.transpose(0, 2, 1), d_mixed, out=d_shown[keys].reshape(key.shape))
    g["near"] = np.bincount(np.maximum(DISTANCE, 0).ravel(), np.where(FUTURE.ravel(), 0, d_near), 2 * STEP).astype(np.float32)
    d_key, d_shown = summed_by(inputs.ravel(), [d_key, d_shown], n_inputs)
    g["embed"], d_query = summed_by(before, [d_state, d_query], n_inputs)
    g["out"] = value_of.T @ d_shown
    for k, d in (("query", d_query * np.float32(WIDTH**-0.5)), ("key", d_key), ("value", d_shown @ p["out"].T)):
        g[k] = like.T @ d
        g["embed"] += d @ p[k].T
    return float(loss), g


def rows_of(ids: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """(inputs, opens, place): texts dealt into rows of STEP.

    inputs: (rows, STEP) embeddings' numbers of what precedes each token, INPUTS + 1 before a text;
    opens: rows that begin a text; place: where each token stands in the rows.
    """
    sizes = np.diff(first)
    count = -(-sizes // STEP)
    base = (np.cumsum(count) - count) * STEP
    place = np.arange(len(ids)) + np.repeat(base - first[:-1], sizes)
    grid = np.full(int(count.sum()) * STEP, INPUTS + 1, np.int16)
    inner = np.ones(len(ids), bool)
    inner[first[:-1][sizes > 0]] = False
    grid[place[inner]] = vocabulary.inputs[ids[np.flatnonzero(inner) - 1]]
    opens = np.zeros(int(count.sum()), bool)
    opens[(base // STEP)[sizes > 0]] = True
    return grid.reshape(-1, STEP), opens, place


def first_rows(first: np.ndarray) -> np.ndarray:
    """The first row of each text, and the end."""
    return np.concatenate([[0], np.cumsum(-(-np.diff(first) // STEP))])


class Trainer:
    """Adam steps on all rows of the token ids that one task reads."""

    def __init__(self, p: dict, vocabulary: Vocabulary, rate: float = RATE, seed: int = 1):
        self.p, self.vocabulary, self.rate = dict(p), vocabulary, rate
        self.draw, self.steps, self.losses, self.read = np.random.default_rng(seed), 0, [], 0  # read: rows of the chunks before, by which learn_all numbers on
        self.first_moment, self.second_moment = ({k: np.zeros_like(p[k]) for k in SHAPES} for _ in range(2))

    def read_rows(self, ids: np.ndarray, first: np.ndarray, base: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """(inputs of the previous and the own row, which of them exist, target slots, which of them exist) of these rows; base: first row of each text and the end."""
        text = np.searchsorted(base, row, "right") - 1
        begin, end = first[text][:, None], first[text + 1][:, None]
        at = begin + ((row - base[text]) * STEP)[:, None] + np.arange(-STEP, STEP)
        inside = (at > begin) & (at <= end)
        inputs = np.where(inside, self.vocabulary.inputs[ids[np.clip(at - 1, 0, len(ids) - 1)]], INPUTS + 1).astype(np.int64)
        own = at[:, STEP:]
        counted = own < end
        return inputs, np.concatenate([at[:, :STEP] >= begin, np.ones_like(counted)], 1), np.where(counted, self.vocabulary.slots[ids[np.minimum(own, len(ids) - 1)]], 0).astype(np.int64), counted

    def draw_rows(self, ids: np.ndarray, first: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
        """ROWS random rows."""
        return self.read_rows(ids, first, base, self.draw.integers(0, base[-1], ROWS))

    def learn(self, ids: np.ndarray, first: np.ndarray, updates: int) -> None:
        """``updates`` steps on rows drawn from these texts; a corpus is learned by ``learn_all``."""
        base = first_rows(first)
        for _ in range(updates if base[-1] else 0):
            self.step(*self.draw_rows(ids, first, base))

    def learn_all(self, ids: np.ndarray, first: np.ndarray, rows: int = ROWS, part: int = 0, parts: int = 1) -> None:
        """Steps of ``rows`` rows over each row of these texts whose number is ``part`` modulo ``parts``, once, in random order."""
        base = first_rows(first)
        order = self.draw.permutation(np.arange((part - self.read) % parts, base[-1], parts))
        for a in range(0, len(order), rows):
            self.step(*self.read_rows(ids, first, base, order[a : a + rows]))
        self.read += int(base[-1])

    def step(self, inputs: np.ndarray, known: np.ndarray, target: np.ndarray, counted: np.ndarray) -> None:
        loss, g = loss_and_gradient(self.p, inputs, known, target, counted)
        self.losses.append(loss)
        self.steps += 1
        for k in SHAPES:
            first, second = self.first_moment[k], self.second_moment[k]
            first *= np.float32(0.9)
            first += np.float32(0.1) * g[k]
            second *= np.float32(0.99)
            second += np.float32(0.01) * g[k] ** 2
            move = np.sqrt(second)
            move += np.float32(1e-8 * (1 - 0.99**self.steps) ** 0.5)
            np.divide(first, move, out=move)
            move *= np.float32(self.rate * (1 - 0.99**self.steps) ** 0.5 / (1 - 0.9**self.steps))
            self.p[k] = self.p[k] - move


class Scorer:
    """Log probabilities of texts under trained parameters."""

    #: Rows that attend at once: all of it stays in the cache. So many times that are dealt by class at once.
    BLOCK, TIMES = 128, 8

    def __init__(self, vocabulary: Vocabulary, p: dict):
        self.vocabulary, self.p = vocabulary, p
        self.query, self.key, _, self.shown = (x.astype(np.float32) for x in tables_of(p))
        norm = lambda x, axis=1: np.linalg.norm(x, axis=axis).max()
        state = norm(p["embed"]) + norm(self.shown)
        self.scores_clipped = norm(self.query) * norm(self.key) + np.abs(p["near"]).max() > 60  # else no score or logit can overflow
        self.logits_clipped = state * max(norm(p["logit"], 0), norm(p["member"])) > 80
        self.near, self.ones = near_of(p).astype(np.float32), np.ones(max(2 * STEP, MEMBERS), np.float32)
        self.sums = np.stack([np.ones(CLASSES + 2), vocabulary.opening], 1).astype(np.float32)
        self.inside = np.ascontiguousarray(p["inside"].transpose(1, 0, 2))  # a class's part stays in the cache

    def states(self, grid: np.ndarray, opens: np.ndarray, a: int, b: int) -> np.ndarray:
        """Hidden states of the places of rows a to b."""
        own = grid[a:b].ravel()
        both = np.concatenate([grid[a - 1] if a else grid[0], own])
        key, shown = (as_pairs(table.take(both, 0)) for table in (self.key, self.shown))
        scores = self.query.take(own, 0).reshape(-1, STEP, WIDTH) @ key.transpose(0, 2, 1)
        scores += self.near
        scores[opens[a:b], :, :STEP] = BAN
        if self.scores_clipped:
            np.minimum(scores, 60, out=scores)
        np.exp(scores, out=scores)
        mixed = (scores @ shown).reshape(-1, WIDTH)
        mixed /= (scores.reshape(-1, 2 * STEP) @ self.ones[: 2 * STEP])[:, None]
        mixed += self.p["embed"].take(own, 0)
        return mixed

    def powers(self, logits: np.ndarray) -> np.ndarray:
        if self.logits_clipped:
            np.minimum(logits, 80, out=logits)
        return np.exp(logits, out=logits)

    def logs(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs, given what is before in the text (first[i]..first[i+1]): of each id's probability, and of the chance that an id there opens a word or ends the text."""
        if not len(ids):
            return np.zeros(0), np.zeros(0)
        grid, opens, place = rows_of(ids, first, self.vocabulary)
        slots, kinds = np.full(grid.size, OWN, np.int16), np.full(grid.size, CLASSES, np.int16)
        slots[place], kinds[place] = self.vocabulary.slots[ids], self.vocabulary.classes[ids]
        log, opening = np.empty(grid.size, np.float32), np.empty(grid.size, np.float32)
        grid = grid.astype(np.int64)
        inputs, line = grid.ravel(), np.arange(self.BLOCK * STEP)
        for top in range(0, len(grid), self.BLOCK * self.TIMES):
            end, states = min(len(grid), top + self.BLOCK * self.TIMES), []
            for a in range(top, end, self.BLOCK):
                b = min(end, a + self.BLOCK)
                span = slice(a * STEP, b * STEP)
                states.append(self.states(grid, opens, a, b))
                logits = states[-1] @ self.p["logit"]
                logits += self.p["pair"].take(inputs[span], 0)
                chosen = logits[line[: len(logits)], kinds[span]]
                sums = np.log(self.powers(logits) @ self.sums + np.float32(1e-30))
                log[span] = chosen - sums[:, 0]
                opening[span] = sums[:, 1] - sums[:, 0]
            state, base = np.concatenate(states), top * STEP
            mine = slots[base : end * STEP]
            order = np.argsort(mine, kind="stable")
            edge = np.searchsorted(mine[order], np.arange(0, OWN + 1, MEMBERS))
            for k in np.flatnonzero(np.diff(edge)).tolist():
                some = order[edge[k] : edge[k + 1]]
                logits = state.take(some, 0) @ self.p["member"][k]
                logits += self.inside[k].take(inputs[base + some], 0)
                chosen = logits[np.arange(len(some)), mine[some] - k * MEMBERS]
                log[base + some] += chosen - np.log(self.powers(logits) @ self.ones[:MEMBERS])
        return (log[place] + self.vocabulary.inside[ids]).astype(np.float64), opening[place].astype(np.float64)
