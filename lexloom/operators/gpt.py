"""A small pre-norm transformer language model in numpy: forward, gradients, training, sampling.

Training steps run on the driver over batches of a bounded size; scoring and sampling
are distributed with the weights broadcast.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import dataset

log = logging.getLogger("lexloom")
Weights = dict[str, np.ndarray]
#: Error function of Abramowitz and Stegun 7.1.26, as in tensor.gelu.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Weights beyond so many bytes are not broadcast.
MOST_BYTES = 2 << 30


@dataclass
class Config:
    vocab_size: int = 50257
    block_size: int = 128
    n_layer: int = 4
    n_head: int = 4
    n_embd: int = 256
    dropout: float = 0.1

    def __post_init__(self):
        if self.n_embd % self.n_head:
            raise ValueError("n_embd must be divisible by n_head")


@dataclass
class Training:
    batch_size: int = 16
    lr: float = 3e-4
    weight_decay: float = 0.1
    max_iters: int = 200
    log_interval: int = 10
    grad_clip: float | None = 1.0
    seed: int = 1337


class Settings:
    """All settings by name, deeply merged over the defaults: Settings({"model": {"n_layer": 2}}).

    An unknown name is kept as it is given; ``config`` and ``schedule`` read the known ones.
    """

    def __init__(self, overrides: dict | None = None):
        self.options = merged({"model": asdict(Config()), "training": asdict(Training())}, overrides or {})

    def __getitem__(self, key: str):
        return self.options[str(key)]

    @property
    def model(self) -> dict:
        return self.options["model"]

    @property
    def training(self) -> dict:
        return self.options["training"]

    def config(self) -> Config:
        return Config(**{k: v for k, v in self.model.items() if k in Config.__dataclass_fields__})

    def schedule(self) -> Training:
        return Training(**{k: v for k, v in self.training.items() if k in Training.__dataclass_fields__})


def merged(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, dictionaries inside one another too; keys become strings."""
    out = dict(base)
    for key, value in over.items():
        key = str(key)
        out[key] = merged(out.get(key) if isinstance(out.get(key), dict) else {}, value) if isinstance(value, dict) else value
    return out


def init(config: Config, seed: int = 1337) -> Weights:
    """Normal embeddings, uniform linear maps of width 1/sqrt(inputs), norms of one and zero."""
    rng, d = np.random.RandomState(seed), config.n_embd

    def uniform(n_in, *shape):
        return rng.uniform(-(n_in**-0.5), n_in**-0.5, shape).astype(np.float32)

    w = {"tok": rng.randn(config.vocab_size, d).astype(np.float32), "pos": rng.randn(config.block_size, d).astype(np.float32)}
    for n in range(config.n_layer):
        for name in "qkvo":
            w[f"{n}.{name}.w"], w[f"{n}.{name}.b"] = uniform(d, d, d), uniform(d, d)
        w[f"{n}.up.w"], w[f"{n}.up.b"] = uniform(d, 4 * d, d), uniform(d, 4 * d)
        w[f"{n}.down.w"], w[f"{n}.down.b"] = uniform(4 * d, d, 4 * d), uniform(4 * d, d)
        for norm in ("ln1", "ln2"):
            w[f"{n}.{norm}.g"], w[f"{n}.{norm}.b"] = np.ones(d, np.float32), np.zeros(d, np.float32)
    w["ln.g"], w["ln.b"] = np.ones(d, np.float32), np.zeros(d, np.float32)
    w["head"] = uniform(d, config.vocab_size, d)
    return w


def _erf_parts(x: np.ndarray):
    z = np.abs(x) * x.dtype.type(0.5**0.5)
    t, poly = 1 / (1 + ERF_P * z), 0.0
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    bell = np.exp(-z * z)
    return np.sign(x) * (1 - poly * bell), bell


class Pass:
    """One forward pass that remembers what the gradients need."""

    def __init__(self, config: Config, w: Weights, ids: np.ndarray, rng: np.random.RandomState | None = None):
        if ids.shape[1] > config.block_size:
            raise ValueError("the sequence is longer than block_size")
        self.c, self.w, self.ids, self.rng, self.back = config, w, ids, rng, []
        self.grads: Weights = {}
        size = ids.shape[1]
        self.hidden_keys = np.triu(np.ones((size, size), bool), 1)
        x = self._drop(w["tok"][ids] + w["pos"][:size], self._embedding_back)
        for n in range(config.n_layer):
            x = self._block(x, n)
        self.x, self._norm_back = self._norm(x, "ln")
        self.logits = self.x @ w["head"].T

    # -- pieces: each returns its value and a function from the value's gradient to the input's ------
    def _add(self, name: str, g: np.ndarray) -> None:
        self.grads[name] = self.grads[name] + g if name in self.grads else g

    def _mask(self, x):
        if self.rng is None or not self.c.dropout:
            return None
        return (self.rng.random_sample(x.shape) >= self.c.dropout).astype(x.dtype) / x.dtype.type(1 - self.c.dropout)

    def _drop(self, x, back=None):
        mask = self._mask(x)
        if back is not None:
            self.back.append(lambda g: back(g if mask is None else g * mask))
        return x if mask is None else x * mask

    def _dropped(self, x):
        mask = self._mask(x)
        return (x, lambda g: g) if mask is None else (x * mask, lambda g: g * mask)

    def _embedding_back(self, g):
        tok = np.zeros_like(self.w["tok"])
        np.add.at(tok, self.ids, g)
        pos = np.zeros_like(self.w["pos"])
        pos[: g.shape[1]] = g.sum(0)
        self._add("tok", tok)
        self._add("pos", pos)

    def _linear(self, x, name):
        def back(g):
            self._add(f"{name}.w", g.reshape(-1, g.shape[-1]).T @ x.reshape(-1, x.shape[-1]))
            self._add(f"{name}.b", g.sum((0, 1)))
            return g @ self.w[f"{name}.w"]

        return x @ self.w[f"{name}.w"].T + self.w[f"{name}.b"], back

    def _norm(self, x, name):
        middle = x - x.mean(-1, keepdims=True)
        scale = 1 / np.sqrt((middle * middle).mean(-1, keepdims=True) + x.dtype.type(1e-5))
        y = middle * scale

        def back(g):
            self._add(f"{name}.g", (g * y).sum((0, 1)))
            self._add(f"{name}.b", g.sum((0, 1)))
            g = g * self.w[f"{name}.g"]
            return scale * (g - g.mean(-1, keepdims=True) - y * (g * y).mean(-1, keepdims=True))

        return y * self.w[f"{name}.g"] + self.w[f"{name}.b"], back

    def _attention(self, x, n):
        b, t, d = x.shape
        heads, width = self.c.n_head, d // self.c.n_head
        split = lambda v: v.reshape(b, t, heads, width).transpose(0, 2, 1, 3)
        join = lambda v: v.transpose(0, 2, 1, 3).reshape(b, t, d)
        (q, back_q), (k, back_k), (v, back_v) = (self._linear(x, f"{n}.{name}") for name in "qkv")
        q, k, v, root = split(q), split(k), split(v), x.dtype.type(width**-0.5)
        s = np.where(self.hidden_keys, x.dtype.type(-1e9), q @ k.transpose(0, 1, 3, 2) * root)
        p = np.exp(s - s.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        shown, back_drop = self._dropped(p)
        out, back_o = self._linear(join(shown @ v), f"{n}.o")

        def back(g):
            g = split(back_o(g))
            gp = back_drop(g @ v.transpose(0, 1, 3, 2))
            gs = p * (gp - (gp * p).sum(-1, keepdims=True)) * root
            return back_q(join(gs @ k)) + back_k(join(gs.transpose(0, 1, 3, 2) @ q)) + back_v(join(shown.transpose(0, 1, 3, 2) @ g))

        return out, back

    def _feed(self, x, n):
        up, back_up = self._linear(x, f"{n}.up")
        erf, bell = _erf_parts(up)
        half = up.dtype.type(0.5)
        act, back_drop = self._dropped(up * half * (1 + erf))
        out, back_down = self._linear(act, f"{n}.down")
        slope = half * (1 + erf) + up * bell * up.dtype.type((2 * np.pi) ** -0.5)
        return out, lambda g: back_up(back_drop(back_down(g)) * slope)

    def _block(self, x, n):
        for norm, part in (("ln1", self._attention), ("ln2", self._feed)):
            y, back_norm = self._norm(x, f"{n}.{norm}")
            y, back_part = part(y, n)
            y, back_drop = self._dropped(y)
            self.back.append(lambda g, a=back_norm, b=back_part, c=back_drop: g + a(b(c(g))))
            x = x + y
        return x

    # -- loss ----------------------------------------------------------------------------------------
    def losses(self, targets: np.ndarray) -> np.ndarray:
        """-log softmax of every target."""
        top = self.logits.max(-1, keepdims=True)
        total = np.log(np.exp(self.logits - top).sum(-1)) + top[..., 0]
        return total - np.take_along_axis(self.logits, targets[..., None], -1)[..., 0]

    def gradients(self, targets: np.ndarray) -> Weights:
        """Of the mean loss, by weight."""
        p = np.exp(self.logits - self.logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        np.put_along_axis(p, targets[..., None], np.take_along_axis(p, targets[..., None], -1) - 1, -1)
        p /= p.dtype.type(targets.size)
        self._add("head", p.reshape(-1, p.shape[-1]).T @ self.x.reshape(-1, self.x.shape[-1]))
        g = self._norm_back(p @ self.w["head"])
        for step in reversed(self.back):
            g = step(g)
        return self.grads


def clip(grads: Weights, limit: float) -> float:
    """Scale all gradients in place if their joint norm is over the limit; the norm before."""
    norm = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values())))
    if norm > limit:
        for g in grads.values():
            g *= g.dtype.type(limit / (norm + 1e-6))
    return norm


def filter_top(logits: np.ndarray, k: int) -> np.ndarray:
    """Everything below the k-th largest out; ties at the k-th stay."""
    k = min(k, logits.shape[-1])
    return np.where(logits < np.partition(logits, -k)[..., -k, None], -np.inf, logits)


@dataclass
class Gpt:
    config: Config
    weights: Weights = field(default_factory=dict)

    def __post_init__(self):
        self.weights = self.weights or init(self.config)

    def size(self) -> int:
        return sum(w.size for w in self.weights.values())

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return Pass(self.config, self.weights, ids).logits

    def sample(self, ids: list[int], new: int, temperature: float = 1.0, top_k: int | None = None, seed: int = 1337) -> list[int]:
        """The prompt and ``new`` drawn ids. An empty prompt raises."""
        if not ids:
            raise ValueError("the prompt is empty")
        rng, out = np.random.RandomState(seed), list(ids)
        for _ in range(new):
            last = self.logits(np.array([out[-self.config.block_size :]]))[0, -1].astype(np.float64) / temperature
            if top_k:
                last = filter_top(last, top_k)
            p = np.exp(last - last.max())
            out.append(int(min(np.searchsorted(np.cumsum(p / p.sum()), rng.random_sample(), side="right"), len(p) - 1)))
        return out

    def _shared(self, df: DataFrame):
        if sum(w.nbytes for w in self.weights.values()) > MOST_BYTES:
            raise ValueError("the weights are too large to broadcast")
        return df.sparkSession.sparkContext.broadcast((asdict(self.config), self.weights))

    def window_losses(self, windows: DataFrame, rows: int = 32) -> DataFrame:
        """(start, loss) of (start, x, y): the mean loss of each window, ``rows`` windows at a time."""
        shared = self._shared(windows)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            config, weights = Config(**shared.value[0]), shared.value[1]
            for batch in batches:
                found = [np.empty(0)]
                for at in range(0, len(batch), rows):
                    part = batch.iloc[at : at + rows]
                    found.append(Pass(config, weights, np.stack(part["x"])).losses(np.stack(part["y"])).mean(-1))
                yield pd.DataFrame({"start": batch["start"], "loss": np.concatenate(found).astype(float)})

        return windows.select("start", "x", "y").mapInPandas(run, "start bigint, loss double")

    def generate(self, prompts: DataFrame, new: int, temperature: float = 1.0, top_k: int | None = None, seed: int = 1337) -> DataFrame:
        """(doc, ids) with ``new`` ids after each prompt. Draws follow the seed and the prompt's doc; empty prompts stay empty."""
        shared = self._shared(prompts)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = Gpt(Config(**shared.value[0]), shared.value[1])
            for batch in batches:
                own = [zlib.crc32(f"{seed} {doc}".encode()) for doc in batch["doc"]]
                drawn = [model.sample([int(i) for i in ids], new, temperature, top_k, s) if len(ids) else [] for ids, s in zip(batch["ids"], own)]
                yield pd.DataFrame({"doc": batch["doc"], "ids": drawn})

        return prompts.select(F.col("doc").cast("long").alias("doc"), "ids").where("ids is not null").mapInPandas(run, "doc bigint, ids array<int>")


def batches(stream: DataFrame, n_tokens: int, block: int, training: Training) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of every iteration: all starts are drawn first, so one join cuts all windows."""
    spark, size = stream.sparkSession, training.batch_size
    starts = dataset.random_starts(n_tokens, block, size * training.max_iters, training.seed)
    wanted = spark.createDataFrame([(n, s) for n, s in enumerate(starts)], "turn int, start bigint")
    found = wanted.join(dataset.windows(stream, wanted.select("start").distinct(), block), "start").orderBy("turn").select("x", "y")
    rows = found.toLocalIterator(prefetchPartitions=True)  # iterations * batch rows, one partition at a time
    for _ in range(training.max_iters):
        pairs = [next(rows) for _ in range(size)]
        yield np.array([r.x for r in pairs]), np.array([r.y for r in pairs])


class Trainer:
    """AdamW (0.9, 0.95) with decoupled decay and clipped gradients; ``history`` has the losses."""

    def __init__(self, model: Gpt, training: Training):
        self.model, self.training, self.history = model, training, []
        self.m = {k: np.zeros_like(w) for k, w in model.weights.items()}
        self.v = {k: np.zeros_like(w) for k, w in model.weights.items()}
        self.rng = np.random.RandomState(training.seed)

    def step(self, x: np.ndarray, y: np.ndarray) -> float:
        o, model = self.training, self.model
        run = Pass(model.config, model.weights, x, self.rng)
        loss, grads = float(run.losses(y).mean()), run.gradients(y)
        if o.grad_clip:
            clip(grads, o.grad_clip)
        n = len(self.history) + 1
        for name, w in model.weights.items():
            g, m, v = grads[name], self.m[name], self.v[name]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.05) * (g * g - v)
            w *= np.float32(1 - o.lr * o.weight_decay)
            w -= np.float32(o.lr / (1 - 0.9**n)) * m / (np.sqrt(v / np.float32(1 - 0.95**n)) + np.float32(1e-8))
        self.history.append(loss)
        return loss

    def train(self, stream: DataFrame, n_tokens: int, each: Callable[[int, float], None] | None = None) -> "Trainer":
        """Over (pos, id); ``each`` hears of every iteration."""
        for n, (x, y) in enumerate(batches(stream, n_tokens, self.model.config.block_size, self.training)):
            loss = self.step(x, y)
            if n % self.training.log_interval == 0:
                log.info("iteration %d loss %.4f", n, loss)
            if each:
                each(n, loss)
        return self
