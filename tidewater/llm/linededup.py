"""Line dedup with content-defined chunks of lines.

Lines with words are hashed, and a hash rolls over the last ``WINDOW`` line
hashes: a line is a boundary unless that hash is divisible by ``EVERY``, so
boundaries depend only on the lines around them and shift along with inserted
text.  The ``WINDOW`` lines that end at a boundary are a chunk; a line of ``LONG``
words or more is a chunk of its own.  Chunks of fewer than ``LEAST_WORDS`` words
are no repetition of text.

A chunk that occurs more than once is a repetition: the first occurrence, by
(doc_id, hash of the text, place), stays, and the lines of the others go, each
only if its bytes equal those of the line it repeats.  Where a passage begins or
ends beside a line that is no boundary, the match is extended by the
neighbouring line, compared in the same way.  So a repeated passage of two
lines is missed if its last line is no boundary (one in ``EVERY``), a longer one
hardly ever in part.  Since every removed line repeats an earlier one, some
occurrence of each line always stays.

A 64-bit key, the owner and the place of each chunk are shuffled, the texts
once, and the lines of repeated chunks once each.

Defined results: a null text is an empty one, which has nothing to remove;
occurrences within one document count; rows of equal id and text are one owner
and treated alike; blank lines between removed lines go with them; other
columns are ignored by ``dedup`` and kept by ``apply``, which drops a document
of which nothing is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import wordhash as H
from tidewater.llm.common import id_text, settle

WINDOW, EVERY, LONG, LEAST_WORDS = 2, 16, 50, 8


class Lines:
    """The lines of a text; ``at`` numbers those with words, ``h`` and ``n`` are
    their hashes and numbers of words."""

    def __init__(self, text: str):
        raw = text.encode("utf-8", "surrogatepass")
        buf = np.frombuffer(raw + b"\n", dtype=np.uint8)
        self.raw, self.ends = raw, np.flatnonzero(buf == 10)
        self.starts = np.r_[0, self.ends[:-1] + 1]
        blank = H.BLANK[buf]
        words = np.add.reduceat(~blank & np.r_[True, blank[:-1]], self.starts, dtype=np.int64)
        self.at = np.flatnonzero(words)
        self.n = words[self.at]
        self.h = H.spans(buf, self.starts, np.ones(len(buf), dtype=bool), H.PLAIN)[self.at]

    def line(self, k: int) -> bytes | None:
        """The k-th line with words."""
        if not 0 <= k < len(self.at):
            return None
        return self.raw[self.starts[self.at[k]]:self.ends[self.at[k]]]

    def without(self, gone: set[int]) -> tuple[str, int]:
        """The text without the numbered lines, and how many lines went: a
        blank line goes if the lines with words around it, or the text's ends, do."""
        drop = np.zeros(len(self.starts), dtype=bool)
        drop[self.at[sorted(gone)]] = True
        before = np.searchsorted(self.at, np.arange(len(drop)), side="right") - 1
        own = np.isin(np.arange(len(drop)), self.at)
        flags = np.r_[drop[self.at], True]                      # -1: the text's beginning and end
        after = np.minimum(before + 1, len(self.at))
        drop = np.where(own, drop, flags[before] & flags[after])
        keep = np.flatnonzero(~drop).tolist()
        return b"\n".join([self.raw[self.starts[k]:self.ends[k]] for k in keep]).decode("utf-8", "surrogatepass"), int(drop.sum())


def boundaries(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash that rolls over ``WINDOW`` line hashes, from the first full
    window on, and whether the window's last line is a boundary."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    roll = np.full(n, WINDOW, dtype=np.uint64)
    for j in range(WINDOW):
        roll = roll * np.uint64(H.P) + h[j:j + n]
    roll = H.mix(roll)
    return roll, (roll >> np.uint64(8)) % np.uint64(EVERY) != 0


def chunks(t: Lines) -> list[tuple[int, int, int]]:
    """``(key, last line, lines)`` of the chunks that count."""
    roll, cut = boundaries(t.h)
    total = np.concatenate([[0], np.cumsum(t.n)])
    end = np.arange(len(roll)) + WINDOW
    ok = cut & (total[end] - total[end - WINDOW] >= LEAST_WORDS)
    out = [(k, e, WINDOW) for k, e in zip(roll[ok].view(np.int64).tolist(), (end[ok] - 1).tolist())]
    long = np.flatnonzero(t.n >= LONG)
    return out + [(k, e, 1) for k, e in zip(H.mix(t.h[long] + np.uint64(1)).view(np.int64).tolist(), long.tolist())]


def occurrences(docs: DataFrame) -> DataFrame:
    """``(key, lines, own)`` of every chunk that counts; ``own`` = (doc_id, th, at)."""
    def run(batches):
        for b in batches:
            found = [(r, *c) for r, text in enumerate(b.column(2).to_pylist()) for c in chunks(Lines(text))]
            row, key, at, n = zip(*found) if found else ((),) * 4
            take = pa.array(row, type=pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, type=pa.int64()), pa.array(n, type=pa.int32()), b.column(0).take(take), b.column(1).take(take),
                                              pa.array(at, type=pa.int64())], ["key", "lines", "doc_id", "th", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select("doc_id", "th", "text").mapInArrow(run, f"key bigint, lines int, doc_id {kind}, th bigint, at bigint")
    return got.select("key", "lines", F.struct("doc_id", "th", "at").alias("own"))


_SIDES = ("before", "upper", "line", "after")      # lines at -2, -1, 0 and +1 of a chunk's last one


def changed(d: DataFrame) -> DataFrame:
    """``(doc_id, th, text, n_removed)`` of the texts ``(doc_id, th, text)``
    that lose lines; all others stay as they are.

    Texts are shuffled once, to meet the places of their repeated chunks; from
    there on only texts that hold such chunks, and those chunks' lines, move.
    """
    kind = d.schema["doc_id"].dataType.simpleString()
    occ = settle(occurrences(d))
    firsts = settle(occ.groupBy("key", "lines").agg(F.min("own").alias("first"), F.max("own").alias("last")).filter("first <> last").select("key", "lines", "first"))
    places = occ.join(firsts, ["key", "lines"]).distinct().select(
        "own.doc_id", "own.th", F.struct("key", "lines", "own.at", (F.col("own") == F.col("first")).alias("first")).alias("x"))
    lists = (places.groupBy("doc_id", "th").agg(F.collect_list("x").alias("all"))
             .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "all"))
    held = settle(d.join(lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
                  .select("doc_id", "th", "text", "all"))

    def fetch(batches):
        for b in batches:
            for i, th, text, every in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                t = Lines(text)
                cut = boundaries(t.h)[1]
                repeats = {x["at"] for x in every if x["lines"] == WINDOW and not x["first"]}
                out = []
                for x in every:
                    at, pair, first = x["at"], x["lines"] == WINDOW, x["first"]
                    # a copy's upper line is compared once, with the chunk that it ends if that is a copy too;
                    # the neighbours matter beside a line that is no boundary
                    upper = t.line(at - 1) if pair and (first or at - 1 not in repeats) else None
                    before = t.line(at - WINDOW) if pair and at - WINDOW >= 0 and not cut[at - WINDOW] else None
                    after = t.line(at + 1) if pair and at + 1 < len(t.at) and not cut[at + 2 - WINDOW] else None
                    out.append((x["key"], x["lines"], at, first, before, upper, t.line(at), after))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], type=pa.int64()), pa.array(cols[1], type=pa.int32()), pa.array([i] * len(out), type=b.column(0).type),
                     pa.array([th] * len(out), type=pa.int64()), pa.array(cols[2], type=pa.int64()), pa.array(cols[3], type=pa.bool_()),
                     *(pa.array(c, type=pa.binary()) for c in cols[4:])], ["key", "lines", "doc_id", "th", "at", "first", *_SIDES])

    found = settle(held.mapInArrow(fetch, f"key bigint, lines int, doc_id {kind}, th bigint, at bigint, first boolean, " + ", ".join(f"{c} binary" for c in _SIDES)))
    originals = settle(found.filter("first").dropDuplicates(["key", "lines"]).select("key", "lines", *[F.col(c).alias(f"o_{c}") for c in _SIDES]))
    same = {c: F.coalesce(F.col(c) == F.col(f"o_{c}"), F.lit(False)) for c in _SIDES}
    both = found.filter("NOT first").join(originals, ["key", "lines"]).filter(same["line"] & (F.col("upper").isNull() | same["upper"]))
    gone = F.array_compact(F.array(F.col("at"), F.when(F.col("upper").isNotNull(), F.col("at") - 1),
                                   F.when(same["before"], F.col("at") - 2), F.when(same["after"], F.col("at") + 1)))
    drop = (both.select("doc_id", "th", F.explode(gone).alias("at")).groupBy("doc_id", "th").agg(F.collect_set("at").alias("drop"))
            .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "drop"))
    losing = held.select("doc_id", "th", "text").join(drop, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))

    def remove(batches):
        for b in batches:
            done = [Lines(text).without(set(at)) for text, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in done], type=pa.string()), pa.array([x[1] for x in done], type=pa.int64())],
                                             ["doc_id", "th", "text", "n_removed"])

    done = losing.select("doc_id", "th", "text", "drop").mapInArrow(remove, f"doc_id {kind}, th bigint, text string, n_removed bigint")
    return settle(done.dropDuplicates(["doc_id", "th"]))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))


def _changed(d: DataFrame) -> DataFrame:
    return changed(d).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("text").alias("__text"), "n_removed")


def _same() -> F.Column:
    return F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_lines, n_removed)`` of every row, repeated chunks
    removed; both numbers count lines."""
    d = _rows(docs, id_col, text_col)
    return d.join(_changed(d), _same(), "left").select(
        "doc_id", F.coalesce("__text", "text").alias("text"), _lines("text"), F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"))


def _lines(text: str) -> F.Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup`` with the SHA-256 of each text in its place; the unchanged
    texts are hashed where they are read."""
    d = _rows(docs, id_col, text_col)
    new = _changed(d).select("__id", "__th", "n_removed", F.sha2("__text", 256).alias("__sha"))
    return d.select("doc_id", "th", _lines("text"), F.sha2("text", 256).alias("sha")).join(new, _same(), "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("__sha", "sha").alias("text_sha256"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their shortened texts, all other columns as they
    were; those that lost every line go."""
    new = _changed(_rows(docs, id_col, text_col)).drop("n_removed")
    th = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    j = docs.join(new, F.col(id_col).eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left").filter("__text IS NULL OR __text <> ''")
    return j.select(*[F.coalesce(F.col("__text"), F.col(text_col)).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])
