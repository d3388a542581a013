"""Line dedup by winnowing over line hashes.

Of every ``window`` consecutive lines the one with the least hash (the first of ties) is
selected as a fingerprint: equal windows select equal lines, so texts that share ``window``
lines share a fingerprint, and there are fewer fingerprints than windows. Fingerprints
that occur at one place only end there. At the others the match is extended both ways over the
neighbouring line hashes, as far as the windows reach that selected the line; what equals
an earlier place is a later repeated run, and runs that touch grow into whole ones. Their
lines are deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.bytesets import Prefix, blocks, expand, flat, words as words_of
from lexloom.llm.rows import marked, tagged
from lexloom.llm.staging import stage

#: Bytes of text in a record batch that is handed on.
HANDED = 4 << 20
#: Parts of a fingerprint's places; half as many of a window's.
SALTS = 16
#: A fingerprint's text, the first line of its reach, both hashes of the lines there, and its windows.
PRINTS = "fingerprint bigint, print bigint, pos int, first array<bigint>, second array<bigint>, codes array<int>"


def line_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the lines of each text, parted by line feeds; an empty text has one."""
    feeds = np.flatnonzero(data == 10)
    first = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    opens = np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    closes = np.zeros(first[-1], bool)
    closes[first[1:] - 1] = True
    starts, ends = np.empty(len(opens), np.int64), np.empty(len(opens), np.int64)
    starts[opens], starts[~opens] = offsets[:-1], feeds + 1
    ends[closes], ends[~closes] = offsets[1:], feeds
    return starts, ends, first


def windows_of(first: np.ndarray, hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, selected line) of every window of ``span`` lines inside a text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(text)) + span <= first[1:][text])
    return at, at + np.argmin(np.stack([hashes[at + k] for k in range(span)]), axis=0) if len(at) else at


def fingerprints(data: np.ndarray, offsets: np.ndarray, window: int, words: int | None) -> tuple[np.ndarray, ...]:
    """(text, line in its text, reach, hashes, other hashes, codes of each, codes) of the selected lines.

    reach: how many lines the windows that selected the line span; a code tells one of these
    windows: ((its first line, from the reach's) * (window + 1) + its lines) * 2 + whether a copy goes.
    """
    starts, ends, first = line_edges(data, offsets)
    h1, h2 = (Prefix(data, salt).ranges(starts, ends) for salt in (0, 1))
    at, chosen = windows_of(first, h1, window)
    span, takes = np.full(len(at), window), np.ones(len(at), bool)
    if words is not None:
        opens = words_of(data, offsets)[0]
        counted = np.concatenate([[0], np.cumsum(np.searchsorted(opens, ends) - np.searchsorted(opens, starts))])
        size = np.repeat(np.diff(first), np.diff(first))
        for k in range(1, window):
            more, line = windows_of(first, h1, k)
            n = counted[more + k] - counted[more]
            at, chosen, span = np.append(at, more), np.append(chosen, line), np.append(span, np.full(len(more), k))
            takes = np.append(takes, (n >= words) | ((size[more] == k) & (n > 0)))
    order = np.lexsort([span, at, chosen])
    at, chosen, span, takes = at[order], chosen[order], span[order], takes[order]
    heads = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(chosen)))
    low = at[heads]
    reach = np.maximum.reduceat(at + span, heads) - low if len(heads) else low
    codes = ((at - np.repeat(low, counts)) * (window + 1) + span) * 2 + takes
    lines, text = expand(low, reach), np.searchsorted(first, low, "right") - 1
    return h1[chosen[heads]], text, low - first[text], reach, h1[lines], h2[lines], counts, codes


def fingerprint_rows(docs: DataFrame, window: int, words: int | None) -> DataFrame:
    """PRINTS with doc_id: the fingerprints of (doc_id, body, print) with the line hashes around them."""

    def lists(sizes, values, kind):
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, kind))

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for row, end in blocks(offsets):
                found = fingerprints(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], window, words)
                own, text, pos, reach, h1, h2, counts, codes = found
                of = pa.array(text + row)
                columns = [batch.column(0).take(of), pa.array(own.view(np.int64)), batch.column(2).take(of), pa.array(pos, pa.int32()), lists(reach, h1.view(np.int64), pa.int64()), lists(reach, h2.view(np.int64), pa.int64()), lists(counts, codes, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "print", "pos", "first", "second", "codes"])

    return docs.select("doc_id", "body", "print").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PRINTS}")


def later_runs(docs: DataFrame, window: int, words: int | None) -> DataFrame:
    """(doc_id, print, runs) of the texts with a run that starts earlier elsewhere; a run is line * (window + 1) + lines."""
    prints = stage(fingerprint_rows(docs, window, words), "fingerprints")
    again = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    # a common line is a common fingerprint, so each is dealt into SALTS parts by place
    again = again.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id", "print", "pos"), F.lit(SALTS)).cast("int"))
    code = F.explode("codes")
    met = salted.join(again, ["fingerprint", "salt"]).select("doc_id", "print", "pos", "first", "second", code.alias("code"))
    half = F.shiftright("code", 1)
    span, lead = half % (window + 1), F.floor(half / (window + 1)).cast("int")
    matches = met.select(
        "doc_id", "print", (F.col("pos") + lead).alias("pos"), span.alias("span"), (F.col("code") % 2 == 1).alias("takes"),
        F.xxhash64(F.slice("first", lead + 1, span)).alias("one"), F.xxhash64(F.lit(2), F.slice("second", lead + 1, span)).alias("two"),
    )
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "print", "pos")
    origins = matches.groupBy("one", "two").agg(F.min(place).alias("origin"), F.max(F.when(F.col("takes"), place)).alias("end")).where("origin < end").drop("end")
    origins = origins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS // 2 - 1))))
    dealt = matches.where("takes").withColumn("salt", F.pmod(F.xxhash64("doc_id", "print", "pos"), F.lit(SALTS // 2)).cast("int"))
    later = dealt.join(origins, ["one", "two", "salt"]).where(place > F.col("origin"))
    return later.groupBy("doc_id", "print").agg(F.collect_set(F.col("pos").cast("long") * (window + 1) + F.col("span")).alias("runs"))


def cut_rows(docs: DataFrame, window: int = 3, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """(row, n_lines, n_removed): ``remove_runs`` with each row of the table as a struct, so that no name can clash."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("print"))
    runs = later_runs(slim, window, words)
    names = docs.columns
    at = names.index(text)

    def cut(batches):
        for batch in batches:
            whole = batch.column(0)
            texts = whole.field(at)
            data, offsets = flat(texts)
            for row, end in blocks(offsets, HANDED):
                part, own = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
                size = end - row
                n_lines = np.diff(np.searchsorted(np.flatnonzero(part == 10), own)) + 1
                if texts.null_count:
                    n_lines[texts.slice(row, size).is_null().to_numpy(zero_copy_only=False)] = 0
                found = batch.column(1).slice(row, size)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                hit &= n_lines > 0
                removed, cut_texts = np.zeros(size, np.int64), []
                for k in np.flatnonzero(hit).tolist():
                    lines = part[own[k] : own[k + 1]].tobytes().split(b"\n")
                    keep = np.ones(len(lines), bool)
                    keep[expand(*np.divmod(np.asarray(found[k].values, np.int64), window + 1))] = False
                    removed[k] = len(lines) - int(keep.sum())
                    cut_texts.append(b"\n".join([line for line, kept in zip(lines, keep.tolist()) if kept]))
                columns = [whole.field(i).slice(row, size) for i in range(len(names))]
                if cut_texts:
                    columns[at] = pc.replace_with_mask(columns[at], pa.array(hit), pa.array(cut_texts, pa.binary()).cast(columns[at].type))
                rows = pa.StructArray.from_arrays(columns, fields=list(whole.type))
                yield pa.RecordBatch.from_arrays([rows, pa.array(n_lines.astype(np.int64)), pa.array(removed)], ["row", "n_lines", "n_removed"])

    joined = marked(tagged(docs, key, text), runs, "left")
    row = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    schema = T.StructType([T.StructField("row", row), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.select("row", "runs").mapInArrow(cut, schema)


def remove_runs(docs: DataFrame, window: int = 3, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """Delete every run of ``window`` or more lines that an earlier place has; keep the first.

    A line goes if it is in a window of lines whose equal starts earlier, in the order of (key,
    line number); null keys come last. Returns all of the table's columns with ``text`` cut
    (nulls stay null), and n_lines and n_removed (0 for null texts; an empty text has one
    line), which take the place of columns of these names; no other name matters. Rows equal in
    key and text count as one document and keep the same lines. Shorter texts stay whole; an
    empty table stays empty. The kept lines are joined by line feeds again. Lines are equal if
    two 61-bit hashes of them are.

    With ``words``, a run of fewer lines goes too if an earlier place has it and it holds so many
    words or is a whole text with a word. Every line is then a fingerprint.
    """
    cut = cut_rows(docs, window, key, text, words)
    return cut.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
