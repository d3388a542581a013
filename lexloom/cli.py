"""Command line: train a tokenizer and a small language model on text files, print the losses and a sample.

    python -m lexloom.cli --data DIR --tokenizer word --merges 2000 --iters 200 --prompt "..."

Defaults come from LEXLOOM_* variables (LEXLOOM_DATA, LEXLOOM_TOKENIZER, LEXLOOM_MERGES, ...).
"""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import dataset, gpt, pretrained, tokenizer
from lexloom.plans.cut import cut
from lexloom.sources import corpus

#: Option, type and default of every setting.
OPTIONS = {
    "data": (str, "data"),
    "tokenizer": (str, "word"),
    "tokenizer_file": (str, ""),
    "merges": (int, 2000),
    "min_freq": (int, 2),
    "prompt": (str, "人间有味是清欢"),
    "block_size": (int, 64),
    "layers": (int, 2),
    "heads": (int, 2),
    "embed": (int, 128),
    "dropout": (float, 0.1),
    "batch": (int, 16),
    "lr": (float, 3e-4),
    "weight_decay": (float, 0.01),
    "iters": (int, 200),
    "log_interval": (int, 20),
    "grad_clip": (float, 1.0),
    "seed": (int, 1337),
    "new_tokens": (int, 64),
}
SHORT = {"data": "-d", "tokenizer": "-t", "merges": "-m", "min_freq": "-f", "block_size": "-b", "layers": "-l", "heads": "-H", "embed": "-e", "batch": "-B", "iters": "-i", "prompt": "-p"}


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lexloom", description=__doc__.split("\n")[0])
    for name, (kind, default) in OPTIONS.items():
        flags = [SHORT[name]] if name in SHORT else []
        choices = ("word", "byte", "pretrained") if name == "tokenizer" else None
        parser.add_argument(*flags, "--" + name.replace("_", "-"), dest=name, type=kind, choices=choices, default=kind(os.environ.get(f"LEXLOOM_{name.upper()}", default)))
    return parser.parse_args(argv)


def logger() -> logging.Logger:
    """To LEXLOOM_LOG (a path, or STDOUT; else standard error) at LEXLOOM_LOG_LEVEL; an unknown level is INFO."""
    log, target = logging.getLogger("lexloom"), os.environ.get("LEXLOOM_LOG", "")
    if not log.handlers:
        import sys

        handler = logging.FileHandler(target) if target not in ("", "STDOUT") else logging.StreamHandler(sys.stdout if target else None)
        handler.setFormatter(logging.Formatter("[%(asctime)s] %(levelname)s %(message)s"))
        log.addHandler(handler)
    level = logging.getLevelName(os.environ.get("LEXLOOM_LOG_LEVEL", "INFO").upper())
    log.setLevel(level if isinstance(level, int) else logging.INFO)
    return log


def tokenizer_of(spark: SparkSession, o: argparse.Namespace) -> tokenizer.Tokenizer:
    """The tokenizer that the settings name; a pre-trained one is a file, or a model below LEXLOOM_MODELS."""
    if o.tokenizer == "pretrained":
        return tokenizer.PretrainedTokenizer(spark, pretrained.resolve(o.tokenizer_file, os.environ.get("LEXLOOM_MODELS", "models")), logger())
    return tokenizer.BpeTokenizer(spark, o.tokenizer, o.merges, o.min_freq, logger())


def plot(losses: list[float], height: int = 12, width: int = 70) -> str:
    """A text chart of the losses, averaged into columns."""
    if not losses:
        return "no iterations"
    columns = [losses[i * len(losses) // width : max(i * len(losses) // width + 1, (i + 1) * len(losses) // width)] for i in range(min(width, len(losses)))] if len(losses) > width else [[v] for v in losses]
    means = [sum(c) / len(c) for c in columns]
    low, high = min(means), max(means)
    level = [round((m - low) / ((high - low) or 1) * (height - 1)) for m in means]
    rows = ["".join("*" if v == h else " " for v in level) for h in range(height - 1, -1, -1)]
    return "\n".join([f"Training Loss  {high:.3f}", *("|" + r for r in rows), f"{low:.3f}  iterations 0..{len(losses) - 1}"])


def run(spark: SparkSession, o: argparse.Namespace) -> tuple[gpt.Trainer, str]:
    """(trainer, sampled text)"""
    log, docs = logger(), cut(corpus.read_texts(spark, o.data))
    if docs.where(F.length(F.trim("text")) > 0).isEmpty():
        raise ValueError(f"no text under {o.data}")
    coder = tokenizer_of(spark, o)
    dataset.ensure_trained(coder, docs)
    stream = cut(dataset.token_stream(coder.encode(docs)))
    tokens, size = stream.count(), coder.vocab_size()
    log.info("%d tokens, %d in the vocabulary", tokens, size)
    model = gpt.Gpt(gpt.Config(size, o.block_size, o.layers, o.heads, o.embed, o.dropout))
    trainer = gpt.Trainer(model, gpt.Training(o.batch, o.lr, o.weight_decay, o.iters, o.log_interval, o.grad_clip, o.seed)).train(stream, tokens)
    prompt = coder.encode(spark.createDataFrame([(0, o.prompt)], "doc_id bigint, text string"))
    text = coder.decode(model.generate(prompt, o.new_tokens, seed=o.seed)).first()
    return trainer, text.text if text else ""


def main(argv: list[str] | None = None) -> None:
    o = parse(argv)
    spark = SparkSession.builder.appName("lexloom").getOrCreate()
    trainer, text = run(spark, o)
    print(plot(trainer.history))
    print("\nSample:\n" + text)


if __name__ == "__main__":
    main()
