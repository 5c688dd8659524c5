"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list that was learned in order ("proper": a rule's parts exist before
the rule) has a finite *sufficient lookahead*: appending text to the end of a
piece can only change tokens within so many symbols of the end.  ``lookahead``
computes that number from the merges by one backward pass: ``reach[t]`` is how
far to the left a difference can still travel, from the current rule on, when
the leftmost token that differs is ``t``.  A rule ``(a, b)`` moves the
difference from ``b`` to ``a`` (``len(a)`` symbols to the left), or lets a
differing ``a`` grow into ``ab`` at the same place.

The encoder therefore holds at most ``lookahead + BLOCK`` symbols of a piece:
it merges that window, emits every token that ends more than ``lookahead``
symbols before the window's end, and goes on from the last emitted boundary.
Short pieces (words) fit into one window and are kept in a bounded cache.

The decoder is a state machine from token ids to text: ids give bytes, and an
incremental UTF-8 decoder keeps the at most three bytes of an unfinished
character between calls.  Vocabularies that name no decoder are rendered as
the library does: the tokens' own strings joined by one space.

Defined results: a null text is an empty one (no tokens, empty decoded text);
repeated rows are encoded each; extra columns are ignored; an empty table
gives an empty table.  Strings of special tokens inside a text give the
special id, as in the library.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import id_text

SHIFT = 24                 # pair key: left << SHIFT | right; value: rank << SHIFT | merged
NONE = 1 << 60
BLOCK = 512                # symbols merged at a time beyond the lookahead
CACHE_WORDS = 300_000      # runs kept by one encoder (about 80 MB)
CACHE_CHARS = 100          # longer runs are encoded each time
GROUP = 1 << 20            # characters of texts whose new words are encoded together
CONTROLS = re.compile("[\x1c-\x1f]")
TEXT_BLOCK = 1 << 16       # characters normalised and split at a time


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte value in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


def lookahead(merges: list[tuple[str, str]], size: Callable[[str], int] = len) -> int:
    """How many symbols from its end a piece's tokens can still change.

    Raises for a merge list in which a rule uses a token made later, for
    which no such bound holds.
    """
    rank_of: dict[str, int] = {}
    for k, (a, b) in enumerate(merges):
        rank_of.setdefault(a + b, k)
    for k, (a, b) in enumerate(merges):
        if rank_of.get(a, -1) >= k or rank_of.get(b, -1) >= k:
            raise ValueError(f"merge {k} uses a token that is made later")
    reach: dict[str, int] = {}
    for a, b in reversed(merges):
        made, left = reach.get(a + b, 0), reach.get(a, 0)
        reach[b] = max(reach.get(b, 0), size(a) + max(left, made))
        reach[a] = max(reach.get(a, 0), made)
    return max((v for t, v in reach.items() if size(t) == 1), default=0)


class Vocabulary:
    """Ids, merges and text rules of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model, norm, pre = j["model"], j.get("normalizer"), j.get("pre_tokenizer") or {}
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = lookahead(merges, lambda t: len(t.removesuffix(self.suffix) if self.suffix else t))
        self.pairs: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            self.pairs.setdefault(self.ids[a] << SHIFT | self.ids[b], k << SHIFT | self.ids[a + b])
        sym = byte_symbols()
        self.inner = [self.ids[s] for s in sym]
        self.last = [self.ids[s + self.suffix] for s in sym]
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens") or []}
        self.special_split = (regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
                              if self.special else None)
        kinds = [n["type"] for n in (norm or {}).get("normalizers", [norm] if norm else [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next((p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split"), None)
        if split is None:
            raise ValueError("only vocabularies with a Split pattern are read")
        # \s of the file's pattern language is Unicode white space
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.has_decoder = bool(j.get("decoder"))
        self.pieces = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in self.ids.items():
            self.pieces[i] = t
        for t, i in self.special.items():
            self.pieces[i] = t
        back = {s: b for b, s in enumerate(sym)}
        special_ids = set(self.special.values())
        self.bytes = [t.encode() if i in special_ids else self._bytes(t, back) for i, t in enumerate(self.pieces)]
        self.space = regex.compile(r"\p{White_Space}+")
        order = sorted(self.pairs)
        self.keys_np = np.array(order, dtype=np.int64)
        self.values_np = np.array([self.pairs[k] for k in order], dtype=np.int64)
        self.inner_np, self.last_np = np.array(self.inner, dtype=np.int64), np.array(self.last, dtype=np.int64)
        self.id_text = [str(i) for i in range(len(self.pieces))]

    def _bytes(self, token: str, back: dict[str, int]) -> bytes:
        end = bool(self.suffix) and token.endswith(self.suffix)
        body = token[: len(token) - len(self.suffix)] if end else token
        return bytes(back[c] for c in body if c in back) + (b" " if end else b"")


def merge(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Apply the merges to one window: lowest rank first, leftmost first."""
    get = pairs.get
    ranks = [get(a << SHIFT | b, NONE) for a, b in zip(symbols, symbols[1:])]
    while ranks:
        best = min(ranks)
        if best == NONE:
            break
        i = ranks.index(best)
        made = symbols[i] = best & ((1 << SHIFT) - 1)
        del symbols[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(made << SHIFT | symbols[i + 1], NONE)
        if i:
            ranks[i - 1] = get(symbols[i - 1] << SHIFT | made, NONE)
    return symbols


def merge_many(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """``merge`` for many short pieces at once: each round merges, in every
    piece that still has a rule, its lowest and leftmost pair."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    sym = v.inner_np[np.frombuffer(b"".join(words), dtype=np.uint8)]
    ends = np.cumsum(size) - 1
    sym[ends] = v.last_np[np.frombuffer(bytes(w[-1] for w in words), dtype=np.uint8)]
    piece = np.repeat(np.arange(len(words)), size)
    out: list[list[int]] = [[]] * len(words)

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << SHIFT | right
        at = np.searchsorted(v.keys_np, key)
        at[at == len(v.keys_np)] = 0
        return np.where(v.keys_np[at] == key, v.values_np[at], NONE)

    ranks = np.full(len(sym), NONE)
    ranks[:-1] = np.where(piece[1:] == piece[:-1], rank(sym[:-1], sym[1:]), NONE)
    while len(sym):
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        best = np.minimum.reduceat(ranks, starts)
        count = np.diff(np.r_[starts, len(sym)])
        done = best == NONE
        if done.any():
            for k, a, n in zip(piece[starts[done]].tolist(), starts[done].tolist(), count[done].tolist()):
                out[k] = sym[a:a + n].tolist()
            keep = ~np.repeat(done, count)
            sym, ranks, piece = sym[keep], ranks[keep], piece[keep]
            if not len(sym):
                break
            best, count = best[~done], count[~done]
        hit = np.flatnonzero(ranks == np.repeat(best, count))
        hit = hit[np.r_[True, piece[hit[1:]] != piece[hit[:-1]]]]
        sym[hit] = best & ((1 << SHIFT) - 1)
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        hit -= np.arange(len(hit))          # places after the removals
        sym, piece, ranks = sym[keep], piece[keep], ranks[keep]
        ranks[hit] = NONE
        more = hit[(hit + 1 < len(sym))]
        more = more[piece[more] == piece[more + 1]]
        ranks[more] = rank(sym[more], sym[more + 1])
        less = hit[hit > 0]
        less = less[piece[less] == piece[less - 1]]
        ranks[less - 1] = rank(sym[less - 1], sym[less])
    return out


class Encoder(dict):
    """Streaming encoder; the dict itself is the bounded cache from a run of
    characters without white space (which no piece can cross) to its ids."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.v = vocab
        self.window = vocab.lookahead + BLOCK
        self.lengths = [len(b) for b in vocab.bytes]
        if vocab.suffix:   # symbols, without the word-end mark
            for i, t in enumerate(vocab.pieces):
                if t.endswith(vocab.suffix):
                    self.lengths[i] -= 1

    def __missing__(self, run: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece, self.v.word.findall(run))))

    def piece(self, word: str) -> Iterable[int]:
        raw = word.encode()
        if len(raw) > self.window:
            return self.stream(raw)
        ids = [self.v.inner[b] for b in raw]
        ids[-1] = self.v.last[raw[-1]]
        return merge(ids, self.v.pairs)

    def prepare(self, texts: list[str]) -> None:
        """Encode all short runs of some texts that the cache lacks, together."""
        want: set[str] = set()
        for t in texts:
            for part in self._blocks(t):
                want.update(self.runs(part))
        missing = [w for w in want.difference(self) if len(w) <= CACHE_CHARS]
        if len(self) + len(missing) > CACHE_WORDS:
            self.clear()
            missing = [w for w in want if len(w) <= CACHE_CHARS]
        for at in range(0, len(missing), CACHE_WORDS):
            runs = missing[at:at + CACHE_WORDS]
            split = self.v.word.findall
            words = [[r] if r.isalpha() else [r[:-1], r[-1]] if r[-1] in ".,!?" and r[:-1].isalpha() else split(r) for r in runs]
            each = list(dict.fromkeys(chain.from_iterable(words)))
            if not each:
                continue
            ids = dict(zip(each, merge_many([w.encode() for w in each], self.v)))
            for r, ws in zip(runs, words):
                self[r] = tuple(ids[ws[0]]) if len(ws) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, ws)))

    def stream(self, raw: bytes) -> Iterator[int]:
        """One piece of any length: emit tokens as soon as they are stable."""
        at, inner, lengths = 0, self.v.inner, self.lengths
        while len(raw) - at > self.window:
            room = self.window
            while True:
                safe, used, n = room - self.v.lookahead, 0, 0
                tokens = merge([inner[b] for b in raw[at:at + room]], self.v.pairs)
                while n < len(tokens) and used + lengths[tokens[n]] <= safe:
                    used += lengths[tokens[n]]
                    n += 1
                if n or at + room >= len(raw):
                    break
                room += BLOCK       # a token longer than a block
            if not n:
                break
            yield from tokens[:n]
            at += used
        ids = [inner[b] for b in raw[at:]]
        ids[-1] = self.v.last[raw[-1]]
        yield from merge(ids, self.v.pairs)

    def _blocks(self, text: str) -> Iterator[str]:
        """Parts of a text cut before a blank, where neither normalisation
        nor a word can reach across."""
        at, n = 0, len(text)
        while n - at > TEXT_BLOCK:
            cut = text.rfind(" ", at + 1, at + TEXT_BLOCK)
            if cut < 0:
                cut = text.find(" ", at + TEXT_BLOCK)
                if cut < 0:
                    break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def runs(self, part: str) -> list[str]:
        """Normalised runs of a block between white space."""
        v = self.v
        if v.nfc and not part.isascii():
            part = unicodedata.normalize("NFC", part)
        if v.lower:
            # letter by letter: no final-sigma rule
            part = part.replace("Σ", "σ").lower()
        # str.split() also cuts at U+001C to U+001F, which are not white space
        return part.split() if CONTROLS.search(part) is None else [w for w in v.space.split(part) if w]

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, a bounded list at a time."""
        split = self.v.special_split
        parts = split.split(text) if split and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [self.v.special[part]]
            elif part:
                for block in self._blocks(part):
                    runs = self.runs(block)
                    if runs:
                        yield list(chain.from_iterable(map(self.__getitem__, runs)))

    def count(self, text: str) -> int:
        return sum(map(len, self.encode(text)))


class Decoder:
    """Ids to text, incrementally: ``push`` returns what is complete."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def push(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.v.has_decoder:
            return self.utf8.decode(b"".join(map(self.v.bytes.__getitem__, ids)))
        lead, self.started = " " if self.started else "", True
        return lead + " ".join(map(self.v.pieces.__getitem__, ids))

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.v.has_decoder else ""


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder of a vocabulary; its word cache outlives a task."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(spec))
    return _ENCODERS[key]


def load_spec(spark: SparkSession, path: str):
    """The tokenizer file (a couple of MB, fixed) as a broadcast variable."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _map(df: DataFrame, spec, schema: str, row: Callable[[Encoder, str], tuple]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        enc = encoder(spec.value)
        for b in batches:
            texts = b.column(1)
            at = 0
            while at < len(texts):
                group, chars = [], 0
                while at < len(texts) and chars < GROUP:
                    group.append(texts[at].as_py())
                    chars += len(group[-1])
                    at += 1
                enc.prepare(group)
                cols = zip(*(row(enc, t) for t in group))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[at - len(group):at], *(pa.array(c, type=t) for c, t in zip(cols, types))],
                    ["doc_id", *names])

    out = df.sparkSession.createDataFrame([], schema).schema
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.dataType.simpleString()] for f in out]
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {schema}")


def _ids(enc: Encoder, text: str) -> tuple:
    ids = list(chain.from_iterable(enc.encode(text)))
    return (ids, len(ids))


def _text(enc: Encoder, text: str) -> tuple:
    dec = Decoder(enc.v)
    return ("".join([*(dec.push(ids) for ids in enc.encode(text)), dec.finish()]),)


def _digests(enc: Encoder, text: str) -> tuple:
    n, hi, ht, dec, as_text = 0, hashlib.sha256(), hashlib.sha256(), Decoder(enc.v), enc.v.id_text.__getitem__
    for ids in enc.encode(text):
        hi.update(((" " if n else "") + " ".join(map(as_text, ids))).encode())
        n += len(ids)
        ht.update(dec.push(ids).encode())
    ht.update(dec.finish().encode())
    return (n, hi.hexdigest(), ht.hexdigest())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, n_tokens)`` of every whole text."""
    return _map(id_text(docs, id_col, text_col), load_spec(docs.sparkSession, path), "ids array<int>, n_tokens bigint", _ids)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of id lists; a null list is empty, a null or unknown
    id is skipped."""
    spec = load_spec(encoded.sparkSession, path)
    df = encoded.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids")

    def run(batches):
        v = encoder(spec.value).v
        n = len(v.pieces)
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                dec = Decoder(v)
                good = [i for i in ids or [] if i is not None and 0 <= i < n]
                texts.append(dec.push(good) + dec.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass over the rows:
    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.  Ids and text stream
    into the digests; neither is held whole."""
    return _map(id_text(docs, id_col, text_col), load_spec(docs.sparkSession, path),
                "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every whole text."""
    return _map(id_text(docs, id_col, text_col), load_spec(docs.sparkSession, path), "n_tokens bigint",
                lambda enc, text: (enc.count(text),))
